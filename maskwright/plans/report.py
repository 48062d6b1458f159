"""Per-sample reports: typed blocks of every layer and scope, and the checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from maskwright.functions.policies import in_roi
from maskwright.operators import match, score, shape
from maskwright.operators.runs import areas, window_fraction
from maskwright.session import held


def stream_blocks(pred: DataFrame, gt: DataFrame, images: DataFrame, roi, threshold: float = 0.5,
                  gt_any_pixel: bool = False) -> DataFrame:
    """Detection block of every image, full frame and ROI.

    The pairs are found once. Predictions and ground truths belong to the ROI by centroid;
    with ``gt_any_pixel`` a ground truth belongs to it with any pixel.
    """
    pairs = held(match.overlap_pairs(pred, gt))

    def members(runs: DataFrame, any_pixel: bool) -> DataFrame:
        if any_pixel:
            return window_fraction(runs, roi).select("image_id", "inst_id", (F.col("inside_px") > 0).alias("_roi"))
        c = shape.centroids(shape.moments(runs))
        return c.select("image_id", "inst_id", in_roi(F.col("cx"), F.col("cy"), roi).alias("_roi"))

    pm, gm = members(pred, False), members(gt, gt_any_pixel)
    out = []
    for scope in ("full_frame", "roi"):
        p = pm if scope == "full_frame" else pm.where("_roi")
        g = gm if scope == "full_frame" else gm.where("_roi")
        sub = pairs
        if scope == "roi":
            sub = pairs.join(p.select("image_id", F.col("inst_id").alias("pred_id")), ["image_id", "pred_id"], "left_semi").join(
                g.select("image_id", F.col("inst_id").alias("gt_id")), ["image_id", "gt_id"], "left_semi")
        area = areas(gt).withColumnRenamed("area", "gt_area").join(g.select("image_id", "inst_id"), ["image_id", "inst_id"], "left_semi")
        per_gt = match.optimal_match(sub, match.optimal_pairs(sub), area, threshold)
        n = p.groupBy("image_id").agg(F.count(F.lit(1)).alias("num_pred"))
        out.append(score.detection_block(per_gt, n, images).withColumn("scope", F.lit(scope)))
    return reduce(DataFrame.unionByName, out)


def sample_report(layers: dict[str, DataFrame], type_label: str = "satellites") -> DataFrame:
    """One JSON document per sample from long blocks (layer, type, scope)."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("layer", F.lit(name)) for name, b in layers.items()])
    body = F.struct(*[c for c in rows.columns if c not in ("image_id", "scope", "layer")])
    entry = F.struct(F.concat_ws(".", "layer", F.lit(type_label), "scope").alias("key"), body.alias("block"))
    return rows.groupBy("image_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("layers"))


def gold_invariant(layers: dict[str, DataFrame], totals: DataFrame) -> DataFrame:
    """Samples where full frame, ROI and total ground-truth counts differ (must be empty for gold data)."""
    out = []
    for name, b in layers.items():
        wide = b.groupBy("image_id").agg(F.max(F.when(F.col("scope") == "full_frame", F.col("num_gt"))).alias("full_num_gt"),
                                         F.max(F.when(F.col("scope") == "roi", F.col("num_gt"))).alias("roi_num_gt"))
        bad = wide.join(totals, "image_id").where("full_num_gt <> num_gt_satellites or roi_num_gt <> num_gt_satellites")
        out.append(bad.select("image_id", F.lit(name).alias("layer"), "full_num_gt", "roi_num_gt"))
    return reduce(DataFrame.unionByName, out)
