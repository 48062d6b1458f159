"""Consecutive numbers without one task seeing a whole group.

``row_number`` over a window puts a group into one task. Here the rows are range
partitioned by (group, order), numbered inside their range, and shifted by the row
counts of the earlier ranges, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maskwright.session import cut, lies_by_image


def _beside(rows: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with the offsets of their range and group; a NULL group is a group like others."""
    right = offsets.withColumnsRenamed({k: f"__{k}" for k in ("_range", *group)})
    same = [rows[k].eqNullSafe(right[f"__{k}"]) for k in ("_range", *group)]
    return rows.join(right, same).drop(*[f"__{k}" for k in ("_range", *group)])


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    start: int = 1,
) -> DataFrame:
    """Add ``name``: 1-based position in ``order`` within ``group``.

    ``order`` must be total inside a group, or equal rows get numbers in free order.
    The tagged rows are written once, because range bounds come from a sample and must
    be the same for both uses. Where images lie together, as none is crowded, a window numbers
    their rows in place.
    """
    if "image_id" in group and lies_by_image(df.sparkSession):
        return df.withColumn(name, (F.row_number().over(W.partitionBy(*group).orderBy(*order)) + F.lit(start - 1)).cast("long"))
    keys = [F.col(g) for g in group]
    tagged = cut(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    inside = W.partitionBy("_range", *group).orderBy(*order)
    numbered = tagged.withColumn("__row", F.row_number().over(inside))
    counts = tagged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("__cnt"))
    # One row per (range, group): at most as many rows per group as there are ranges.
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("_range")
    offsets = counts.select(
        "_range",
        *group,
        (F.sum("__cnt").over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("__cnt")).alias("__off"),
    )
    return (
        _beside(numbered, offsets, group)
        .withColumn(name, (F.col("__row") + F.col("__off") + F.lit(start - 1)).cast("long"))
        .drop("_range", "__row", "__off")
    )


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str],
) -> DataFrame:
    """Add cumulative sums (``{new: source}``) in ``order`` within ``group``, spread like above."""
    keys = [F.col(g) for g in group]
    tagged = cut(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    inside = W.partitionBy("_range", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = tagged
    for new, source in sums.items():
        local = local.withColumn(new, F.sum(source).over(inside))
    totals = tagged.groupBy("_range", *group).agg(
        *[F.sum(source).alias(f"_t_{new}") for new, source in sums.items()]
    )
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("_range")
    before = before.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *group,
        *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums],
    )
    out = _beside(local, offsets, group)
    for new in sums:
        out = out.withColumn(new, F.col(new) + F.col(f"_o_{new}"))
    return out.drop("_range", *[f"_o_{new}" for new in sums])
