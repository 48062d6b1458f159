"""Label maps built from many masks: paint orders, id numbering, merging with streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.policies import CATEGORY_ID, literal_map
from maskwright.operators.numbering import number_rows
from maskwright.operators.runs import IMAGE, MASK, areas, paint, tile_runs, union_runs

MAX_ID = 255
STRIDE = 100_000


def check_capacity(instances: DataFrame, limit: int = MAX_ID) -> DataFrame:
    """Images with more instances than an 8-bit map can name."""
    return instances.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def paint_stream_first(runs: DataFrame, order: str = "inst_id", stream_label: str = "streams") -> tuple[DataFrame, DataFrame]:
    """Streams first (the later stream wins), other masks only on free pixels (the earlier wins).

    Returns the label map and one row per surviving mask with its label number. A stream stays
    even if covered by later ones; another mask stays only with a pixel left.
    """
    is_stream = (F.col("type_label") == stream_label).cast("int")
    first = F.struct(is_stream.alias("s"), F.when(is_stream == 1, F.col(order)).otherwise(-F.col(order)).alias("o"))
    painted = paint(runs, first)
    seen = areas(painted).withColumnRenamed("area", "visible_px")
    masks = runs.select(*MASK, "type_label", *([order] if order not in MASK else [])).distinct()
    alive = masks.join(seen, MASK, "left").withColumn("visible_px", F.coalesce("visible_px", F.lit(0)))
    alive = alive.where((F.col("type_label") == stream_label) | (F.col("visible_px") > 0))
    alive = alive.withColumn("_s", (F.col("type_label") != stream_label).cast("int"))
    ids = number_rows(alive, IMAGE, [F.col("_s"), F.col(order)], "label_id").drop("_s")
    return painted, ids


def paint_last_wins(runs: DataFrame, order: str = "inst_id") -> tuple[DataFrame, DataFrame]:
    """Later masks overwrite earlier ones; every non-empty mask keeps its number."""
    masks = runs.select(*MASK, "type_label", *([order] if order not in MASK else [])).distinct()
    return paint(runs, F.col(order)), number_rows(masks, IMAGE, [F.col(order)], "label_id")


def merge_with_streams(streams: DataFrame, inferred: DataFrame, order: str = "inst_id",
                       policy: str = "keep_streams") -> tuple[DataFrame, DataFrame]:
    """Label map of streams plus inferred masks, and the overlap figures of each image.

    Inferred masks are numbered by position after the largest stream id, empty ones included.
    With ``keep_streams`` they only take free pixels (earlier first), else they overwrite.
    """
    top = streams.groupBy("image_id").agg(F.max("inst_id").alias("_top"))
    numbered = number_rows(inferred.select(*MASK).distinct(), IMAGE, [F.col(order)], "_n")
    numbered = numbered.join(top, "image_id", "left").select(
        *MASK, (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias("new_id"))
    new_runs = inferred.select(*MASK, "y", "x0", "x1").join(numbered, MASK).select(
        "image_id", F.col("new_id").alias("inst_id"), "y", "x0", "x1", F.lit(0).alias("_s"))
    both = streams.select("image_id", "inst_id", "y", "x0", "x1", F.lit(1).alias("_s")).unionByName(new_runs)
    rank: Column = (
        F.struct("_s", F.when(F.col("_s") == 1, F.col("inst_id")).otherwise(-F.col("inst_id")).alias("_o"))
        if policy == "keep_streams"
        else F.struct((1 - F.col("_s")).alias("_s"), F.col("inst_id").alias("_o"))
    )
    painted = paint(both, rank)
    at = ["image_id", "y", "tile"]
    free = union_runs(streams).select(*at, F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    hit = tile_runs(inferred).join(free, at).where("x0 < _b1 AND _b0 < x1").groupBy("image_id").agg(
        F.sum(F.expr("cast(least(x1, _b1) - greatest(x0, _b0) as bigint)")).alias("overlap_px"))
    total = inferred.groupBy("image_id").agg(
        F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("inferred_px"))
    count = numbered.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_inferred"))
    written = painted.join(numbered.select("image_id", F.col("new_id").alias("inst_id")), MASK, "left_semi").groupBy(
        "image_id").agg(F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("written_px"))
    stats = total.join(count, "image_id").join(hit, "image_id", "left").join(written, "image_id", "left").na.fill(0)
    return painted, stats.select(
        "image_id", "n_inferred", "inferred_px", "overlap_px",
        (F.col("overlap_px") / F.col("inferred_px")).alias("overlap_rate"), "written_px")


def local_ids(runs: DataFrame) -> DataFrame:
    """Source ids mapped to 1..N in ascending order per image."""
    ids = runs.select(*MASK).distinct()
    return number_rows(ids, IMAGE, [F.col("inst_id")], "local_id").select(
        "image_id", F.col("inst_id").alias("source_instance_id"), "local_id")


def per_class_ids(masks: DataFrame, order: str = "inst_id") -> DataFrame:
    """Local number per (image, class) and a global id that carries the class."""
    numbered = number_rows(masks, ["image_id", "type_label"], [F.col(order)], "local_id")
    index = literal_map(CATEGORY_ID)[F.col("type_label")].cast("long")
    return numbered.withColumn("global_id", index * STRIDE + F.col("local_id"))


def per_class_maps(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Label map of each class, painted in local order; classes may overlap each other."""
    keyed = runs.join(ids.select(*MASK, "local_id"), MASK)
    return paint(keyed, F.col("local_id"), label="local_id", keys=["image_id", "type_label"])


def provenance_columns(instances: DataFrame) -> DataFrame:
    """Source of a row: prediction identity if any is present, a source instance, or unknown."""
    from_pred = F.coalesce("candidate_id", F.col("raw_index").cast("string"), "candidate_rle_sha1").isNotNull()
    from_map = F.col("source_instance_id").isNotNull()
    return instances.withColumn(
        "source",
        F.when(from_pred, F.lit("sam3_post"))
        .when(from_map, F.coalesce("source", F.lit("firebox_sb31.5_fits")))
        .otherwise(F.coalesce("source", F.lit("unknown"))),
    ).withColumn("source_instance_id", F.when(~from_pred, F.col("source_instance_id")))


def id_map(instances: DataFrame, stream_label: str = "streams") -> DataFrame:
    """Per image and class a map from local index (streams: their own id) to instance id.

    One map per image and class is the output format itself; its size is the label capacity.
    """
    ranked = number_rows(instances, ["image_id", "type_label"], [F.col("inst_id")], "_k", start=0)
    key = F.when(F.col("type_label") == stream_label, F.col("inst_id")).otherwise(F.col("_k")).cast("string")
    return ranked.groupBy("image_id", "type_label").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.col("inst_id")))).alias("id_map"))


def reconcile_ids(runs: DataFrame, listed: DataFrame) -> DataFrame:
    """Ids painted in a map against ids in its metadata; ``both`` is what is kept."""
    painted = runs.select(*MASK).distinct().withColumn("_m", F.lit(1))
    named = listed.select(*MASK).distinct().withColumn("_l", F.lit(1))
    return painted.join(named, MASK, "full_outer").select(
        *MASK,
        F.when(F.col("_l").isNull(), F.lit("map_only")).when(F.col("_m").isNull(), F.lit("listed_only"))
        .otherwise(F.lit("both")).alias("found"))
