"""The audit log followed as it grows: the fold of ``review.audit_fold`` as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def reserved_max(log: DataFrame) -> DataFrame:
    """Largest id ever reserved per image. Works on a static or a streaming log; ids only grow, so
    the state is one number per image and late entries need no watermark."""
    live = log.where(F.col("status").isin("prepared", "committed"))
    return live.groupBy("image_id").agg(F.max(F.greatest("assigned_instance_id", "deleted_instance_id")).alias("max_reserved_id")).where("max_reserved_id is not null")
