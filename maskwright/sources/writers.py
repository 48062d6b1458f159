"""Sinks: prediction documents, COCO documents, line files, CSV tables, outcome buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Optional figures written with a prediction, and the buckets of a cache.
EXTRAS = ("area_clean", "area_raw", "bbox_w", "bbox_h", "centroid_x", "centroid_y", "dist_to_center", "aspect_sym_moment",
          "aspect_sym_boundary", "aspect_sym", "curvature_ratio", "solidity", "reject_reason")
BUCKETS = ("kept", "ambiguous", "dup_rejected", "prior_rejected", "core_rejected")


def prediction_documents(masks: DataFrame, height: int, width: int, layer: str = "raw", engine: str = "sam3", order: str = "raw_index") -> DataFrame:
    """One JSON document per image: header and predictions in order; masks without a string are dropped.

    A document holds the predictions of one image by definition of the format. ``to_json`` omits
    NULL extras.
    """
    extras = [c for c in EXTRAS if c in masks.columns]
    rle = F.struct(F.col("counts").alias("counts"), F.array(F.lit(height), F.lit(width)).alias("size"))
    item = F.struct(F.col(order).alias("_o"), F.struct(
        "type_label", F.bround(F.coalesce("score", F.lit(0.0)), 4).alias("score"), "area", F.array("bbox_x", "bbox_y", "bbox_w_px", "bbox_h_px").alias("bbox_xywh"),
        rle.alias("rle"), "candidate_id", "raw_index", F.substring(F.sha1(F.col("counts").cast("binary")), 1, 16).alias("candidate_rle_sha1"), *extras).alias("p"))
    docs = masks.where("counts is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    body = F.struct(F.lit(1).alias("schema_version"), F.lit("coco_rle_fortran").alias("rle_convention"), F.lit(height).alias("H_work"), F.lit(width).alias("W_work"),
                    F.lit(engine).alias("engine"), F.lit(layer).alias("layer"), F.size("_p").alias("n_predictions"), F.current_timestamp().cast("string").alias("created_at"),
                    F.transform("_p", lambda x: x["p"]).alias("predictions"))
    return docs.select("image_id", F.lit(layer).alias("layer"), F.to_json(body).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    """One line per document, partitioned by layer."""
    docs.select("layer", "value").write.partitionBy("layer").mode("overwrite").text(path)


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """The three tables of a COCO data set as Parquet; see ``coco_lines`` for a JSON form."""
    for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def coco_lines(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One JSON line per image with its annotations nested: a COCO document cut into lines."""
    nested = annotations.groupBy("image_id").agg(F.collect_list(F.struct(*[c for c in annotations.columns if c != "image_id"])).alias("annotations"))
    rows = images.join(nested.withColumnRenamed("image_id", "id"), "id", "left")
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; NULL and NaN are written blank."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_buckets(masks: DataFrame, path: str) -> None:
    """Masks by outcome bucket, one folder each; an unknown bucket fails the job."""
    known = F.col("bucket").isin(*BUCKETS)
    checked = masks.withColumn("bucket", F.when(known, F.col("bucket")).otherwise(F.raise_error(F.concat(F.lit("unknown bucket "), F.col("bucket"))).cast("string")))
    checked.write.partitionBy("bucket").mode("overwrite").parquet(path)
