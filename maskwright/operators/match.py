"""Matching of masks: overlaps, best matches, one-to-one flags, optimal pairs, groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maskwright.functions.policies import Taxonomy, in_roi
from maskwright.operators.runs import areas, boundary_band, tile_runs
from maskwright.operators.tiles import BLOCK, bit_areas, mask_blocks, pixels, run_bits, shared_pixels, side_counts, tile_rows
from maskwright.session import cut, held, shared

PAIR = ["image_id", "pred_id", "gt_id"]


def _sized_blocks(runs: DataFrame, mask: str, area: str) -> DataFrame:
    """Blocks of masks with the area of the whole mask beside each."""
    own = F.expr("aggregate(bits, 0L, (s, v) -> s + bit_count(v))")
    blocks = mask_blocks(runs)
    return blocks.withColumn(area, F.sum(own).over(W.partitionBy("image_id", "inst_id"))).withColumnRenamed("inst_id", mask)


def _right(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({n: f"_{n}" for n in ("lo", "hi", "bits")})


def _pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shared pixels (``inter``) of every pair of blocks' masks, by ``keys``."""
    met = a.join(b, BLOCK).where("lo <= _hi AND _lo <= hi").select(*keys, shared_pixels().alias("_n")).where("_n > 0")
    return met.groupBy(*keys).agg(F.sum("_n").alias("inter"))


def pair_intersections(a: DataFrame, b: DataFrame, left: str = "pred_id", right: str = "gt_id") -> DataFrame:
    """Pixels shared by every pair of masks that touch in the same image.

    Masks travel as blocks, so the join key (image, band, tile) spreads a crowded image over
    many tasks and only pairs meeting in one block are formed.
    """
    pa = mask_blocks(a).withColumnRenamed("inst_id", left)
    return _pairs(pa, _right(mask_blocks(b).withColumnRenamed("inst_id", right)), ["image_id", left, right])


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection, areas, union and IoU of all overlapping (prediction, ground truth) pairs.

    The areas come with the blocks, so the pairs are not joined with the masks again.
    """
    pairs = _pairs(_sized_blocks(a, "pred_id", "pred_area"), _right(_sized_blocks(b, "gt_id", "gt_area")), [*PAIR, "pred_area", "gt_area"])
    pairs = pairs.select("image_id", "gt_id", "pred_id", "inter", "pred_area", "gt_area")
    return pairs.withColumn("union_px", F.col("pred_area") + F.col("gt_area") - F.col("inter")).withColumn(
        "iou", F.col("inter") / F.col("union_px")
    )


def hits(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Overlaps with the ground-truth area only: all that primary matches need."""
    pa = mask_blocks(pred).withColumnRenamed("inst_id", "pred_id")
    return _pairs(pa, _right(_sized_blocks(gt, "gt_id", "gt_area")), [*PAIR, "gt_area"])


def self_overlaps(runs: DataFrame) -> DataFrame:
    """Pairs of different instances of one image that share pixels (id_a < id_b)."""
    blocks = mask_blocks(runs)
    a, b = blocks.withColumnRenamed("inst_id", "id_a"), _right(blocks.withColumnRenamed("inst_id", "id_b"))
    met = a.join(b, BLOCK).where("id_a < id_b AND lo <= _hi AND _lo <= hi")
    met = met.select("image_id", "id_a", "id_b", shared_pixels().alias("_n")).where("_n > 0")
    return met.groupBy("image_id", "id_a", "id_b").agg(F.sum("_n").alias("inter"))


def binary_iou(a: DataFrame, b: DataFrame, images: DataFrame) -> DataFrame:
    """IoU of the unions of both sides per image; two empty sides give 1."""
    both, only_a, only_b = F.col("both"), F.col("only_a"), F.col("only_b")
    counts = images.select("image_id").distinct().join(side_counts(a, b), "image_id", "left").na.fill(0)
    union = both + only_a + only_b
    sides = counts.select("image_id", (both + only_a).alias("pred_px"), (both + only_b).alias("gt_px"), both.alias("inter"), union.alias("union_px"))
    union = F.col("union_px")
    return sides.withColumn(
        "binary_iou", F.when(union == 0, F.lit(1.0)).otherwise(F.col("inter") / union)
    )


def union_vs_instances(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """IoU of the union of all predictions with each ground-truth instance."""
    up = tile_rows(pred, ["image_id"])
    met = tile_rows(gt).join(up.withColumnRenamed("bits", "_u"), ["image_id", "y", "tile"], "left")
    # One aggregation gives both figures, so that the masks are drawn and kept in a task only once.
    own, shared = F.col("bits"), F.col("bits").bitwiseAND(F.coalesce("_u", F.lit(0).cast("long")))
    sides = met.groupBy("image_id", "inst_id").agg(F.sum(pixels(own)).alias("gt_area"), F.sum(pixels(shared)).alias("inter"))
    out = sides.join(bit_areas(up, ["image_id"], "pred_px"), "image_id", "left").na.fill(0)
    out = out.select("image_id", "inst_id", "gt_area", "pred_px", "inter")
    return out.withColumnRenamed("inst_id", "gt_id").withColumn(
        "iou", F.col("inter") / (F.col("pred_px") + F.col("gt_area") - F.col("inter"))
    )


def best_match(pairs: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per ground truth the prediction of largest IoU, smallest index on ties.

    ``pred`` carries ``pred_idx`` (0-based position in its image). Without predictions the
    index is -1; with predictions but no overlap it is 0. A prediction may serve many rows.
    """
    idx = pred.select("image_id", F.col("inst_id").alias("pred_id"), "pred_idx")
    best = (
        pairs.join(idx, ["image_id", "pred_id"])
        .groupBy("image_id", "gt_id")
        .agg(F.max(F.struct("iou", (-F.col("pred_idx")).alias("_i"))).alias("_b"))
    )
    some = pred.select("image_id").distinct().withColumn("_any", F.lit(1))
    out = gt.withColumnRenamed("inst_id", "gt_id").join(best, ["image_id", "gt_id"], "left").join(
        some, "image_id", "left"
    )
    iou = F.coalesce(F.col("_b.iou"), F.lit(0.0))
    return out.select(
        "image_id", "gt_id", "gt_area",
        F.when(F.col("_b").isNotNull(), -F.col("_b._i"))
        .when(F.col("_any").isNotNull(), F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("best_pred_idx"),
        iou.alias("best_iou"),
        (iou >= F.lit(threshold)).alias("detected"),
    )


def best_match_recall(matches: DataFrame, images: DataFrame) -> DataFrame:
    """Recall and mean matched IoU per image; an image without ground truth has zeros."""
    agg = matches.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("num_gt"),
        F.count_if("detected").alias("num_detected"),
        F.avg(F.when(F.col("detected"), F.col("best_iou"))).alias("matched_iou"),
    )
    return images.select("image_id").distinct().join(agg, "image_id", "left").select(
        "image_id",
        F.coalesce("num_gt", F.lit(0)).alias("num_gt"),
        F.coalesce("num_detected", F.lit(0)).alias("num_detected"),
        F.coalesce(F.col("num_detected") / F.col("num_gt"), F.lit(0.0)).alias("recall"),
        F.coalesce("matched_iou", F.lit(0.0)).alias("matched_iou"),
    )


def primary_match(pairs: DataFrame, pred: DataFrame) -> DataFrame:
    """Per prediction the ground truth under most of its pixels (smallest id on ties).

    ``pairs`` needs inter and gt_area, ``pred`` its area column; nothing is thresholded.
    A max over a struct combines on the map side, so a hot image costs no extra.
    """
    best = pairs.groupBy("image_id", "pred_id").agg(
        F.max(F.struct("inter", (-F.col("gt_id")).alias("_g"), "gt_area")).alias("_b")
    )
    return pred.withColumnRenamed("inst_id", "pred_id").join(best, ["image_id", "pred_id"], "left").select(
        *[c for c in pred.columns if c != "inst_id"], "pred_id",
        (-F.col("_b._g")).alias("matched_gt_id"),
        F.coalesce(F.col("_b.inter"), F.lit(0)).alias("overlap_px"),
        F.col("_b.gt_area").alias("matched_gt_area"),
    )


def one_to_one_flags(primary: DataFrame, index: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add ``is_one_to_one``: the prediction covers its primary ground truth more than every
    other prediction with the same primary (smallest ``index`` on ties)."""
    at = ["image_id", "matched_gt_id", *extra]
    winner = (
        primary.where("matched_gt_id is not null")
        .groupBy(*at)
        .agg(F.max(F.struct("overlap_px", (-F.col(index)).alias("_i"))).alias("_w"))
        .select(*at, (-F.col("_w._i")).alias("_win"))
    )
    return (
        primary.join(winner, at, "left")
        .withColumn("is_one_to_one", F.coalesce(F.col(index) == F.col("_win"), F.lit(False)))
        .drop("_win")
    )


def cover_ratios(df: DataFrame, pred_area: str = "area") -> DataFrame:
    """purity, completeness and seed-to-truth ratio; NULL without a matched ground truth."""
    return (
        df.withColumn("purity", F.coalesce(F.try_divide("overlap_px", pred_area), F.lit(0.0)))
        .withColumn("completeness", F.col("overlap_px") / F.col("matched_gt_area"))
        .withColumn("seed_gt_ratio", F.col(pred_area) / F.col("matched_gt_area"))
    )


def classify_candidates(
    pairs: DataFrame,
    pred: DataFrame,
    index: str = "raw_index",
    cfg: Taxonomy = Taxonomy(),
    roi: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Matching class of each prediction. ``pred`` needs area, cx, cy and ``index``."""
    one = cover_ratios(one_to_one_flags(primary_match(pairs, pred), index))
    label = cfg.classify(
        F.col("matched_gt_id"), F.col("purity"), F.col("completeness"),
        F.col("seed_gt_ratio"), F.col("is_one_to_one"),
    )
    return (
        one.withColumn("_l", label)
        .withColumn("taxonomy_label", F.col("_l.taxonomy_label"))
        .withColumn("label_reason", F.col("_l.label_reason"))
        .withColumn("intersects_roi", in_roi(F.col("cx"), F.col("cy"), roi))
        .drop("_l")
    )


def boundary_f1(pairs: DataFrame, pred: DataFrame, gt: DataFrame, height: int, width: int,
                distance: int = 2) -> DataFrame:
    """F1 of the boundary bands of each given pair. Pairs and bands are used several times, so
    they are computed once."""
    pairs = shared(pairs)
    pb = shared(boundary_band(pred.join(pairs.selectExpr("image_id", "pred_id as inst_id").distinct(),
                                 ["image_id", "inst_id"], "left_semi"), height, width, distance))
    gb = shared(boundary_band(gt.join(pairs.selectExpr("image_id", "gt_id as inst_id").distinct(),
                               ["image_id", "inst_id"], "left_semi"), height, width, distance))
    pa = areas(pb).withColumnsRenamed({"inst_id": "pred_id", "area": "_pa"})
    ga = areas(gb).withColumnsRenamed({"inst_id": "gt_id", "area": "_ga"})
    # Join along the wanted pairs: (pair, y, tile) keeps the work to their own rows.
    at = ["image_id", "y", "tile"]
    left = pairs.select(*PAIR).join(pb.withColumnRenamed("inst_id", "pred_id"), ["image_id", "pred_id"])
    right = gb.select(*at, F.col("inst_id").alias("gt_id"), F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    hit = left.join(right, [*at, "gt_id"]).where("x0 < _b1 AND _b0 < x1")
    tp = hit.groupBy(*PAIR).agg(F.sum(F.expr("cast(least(x1, _b1) - greatest(x0, _b0) as bigint)")).alias("_tp"))
    out = (
        pairs.select(*PAIR).join(tp, PAIR, "left")
        .join(pa, ["image_id", "pred_id"], "left").join(ga, ["image_id", "gt_id"], "left").na.fill(0)
    )
    precision = F.coalesce(F.try_divide("_tp", "_pa"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("_tp", "_ga"), F.lit(0.0))
    return out.select(
        *PAIR,
        F.when(precision + recall == 0, F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall)).alias("boundary_f1"),
    )


def two_best(pairs: DataFrame, side: str, other: str) -> DataFrame:
    """Best pair of each mask on ``side`` and the IoU of its second best.

    The rank filter is pushed below the shuffle (window group limit), so at most two rows per
    mask and task travel.
    """
    w = W.partitionBy("image_id", side).orderBy(F.col("iou").desc(), other)
    ranked = pairs.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    keep = [c for c in ("iou", other, "gt_area") if c in pairs.columns]
    return ranked.groupBy("image_id", side).agg(
        F.max(F.when(F.col("_rn") == 1, F.struct(*keep))).alias("best"),
        F.max(F.when(F.col("_rn") == 2, F.col("iou"))).alias("second_iou"),
    )


def match_candidates(
    pairs: DataFrame, pred: DataFrame, bands: DataFrame | None = None, min_overlap: float = 0.05
) -> DataFrame:
    """Per prediction: best and second IoU, best ground truth, area ratio, overlap count.

    Smallest id on ties.
    """
    count = pairs.groupBy("image_id", "pred_id").agg(F.count_if(F.col("iou") >= F.lit(min_overlap)).alias("_n"))
    top = two_best(pairs, "pred_id", "gt_id").join(count, ["image_id", "pred_id"])
    out = pred.withColumnRenamed("inst_id", "pred_id").join(top, ["image_id", "pred_id"], "left").select(
        "image_id", "pred_id", "confidence_score", "filter_status", "area",
        F.col("best.gt_id").alias("best_gt_id"),
        F.coalesce(F.col("best.iou"), F.lit(0.0)).alias("best_iou"),
        F.coalesce(F.col("second_iou"), F.lit(0.0)).alias("second_best_iou"),
        F.expr("area / best.gt_area").alias("area_ratio"),
        (F.coalesce("_n", F.lit(0)) >= 2).alias("overlaps_multiple_gt"),
    )
    if bands is not None:
        out = out.join(
            bands.withColumnRenamed("gt_id", "best_gt_id"), ["image_id", "pred_id", "best_gt_id"], "left"
        )
    return out.drop("area")


def exhaustivity(
    matches: DataFrame, pred_runs: DataFrame, gt_runs: DataFrame, images: DataFrame,
    match_iou: float = 0.3, recall_min: float = 0.9, precision_min: float = 0.9,
) -> DataFrame:
    """Image-level coverage from candidate matches: counts, unmatched areas, confidence flag."""
    ok = (F.col("best_gt_id").isNotNull()) & (F.col("best_iou") >= F.lit(match_iou))
    m = held(matches.withColumn("_ok", ok))
    per = m.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("_np"),
        F.count_if("_ok").alias("num_pred_matched"),
        F.avg(F.when(F.col("_ok"), F.col("best_iou"))).alias("mean_matched_iou"),
    )
    hit_gt = m.where("_ok").selectExpr("image_id", "best_gt_id as inst_id").distinct()
    n_gt = gt_runs.select("image_id", "inst_id").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("num_gt"))
    n_hit = hit_gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("_hit"))
    lost_pred = m.where("NOT _ok").selectExpr("image_id", "pred_id as inst_id").distinct()

    def union_areas(runs: DataFrame, marked: DataFrame, unmatched: Column, side: str) -> DataFrame:
        """Pixels of the unions of all masks and of the unmatched ones, in one aggregation."""
        flagged = tile_runs(runs.select("image_id", "inst_id", "y", "x0", "x1")).join(
            marked.withColumn("_m", F.lit(True)), ["image_id", "inst_id"], "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
        rows = flagged.groupBy("image_id", "y", "tile").agg(
            F.bit_or(run_bits()).alias("_all"), F.bit_or(F.when(unmatched, run_bits())).alias("_un"))
        return rows.groupBy("image_id").agg(
            F.sum(pixels(F.col("_all"))).alias(f"total_{side}_area"), F.sum(pixels(F.col("_un"))).alias(f"unmatched_{side}_area"))

    parts = [n_gt, n_hit, per, union_areas(gt_runs, hit_gt, ~F.col("_m"), "gt"), union_areas(pred_runs, lost_pred, F.col("_m"), "pred")]
    out = images.select("image_id").distinct().withColumn("_image", F.lit(True))
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.groupBy("image_id").agg(*[F.max(c).alias(c) for c in out.columns if c != "image_id"]).where("_image").drop("_image").na.fill(0)
    recall = F.coalesce(F.try_divide("_hit", "num_gt"), F.lit(1.0))
    precision = F.coalesce(F.try_divide("num_pred_matched", "_np"), F.lit(1.0))
    return out.select(
        "image_id", "num_gt", "num_pred_matched",
        (F.col("num_gt") - F.col("_hit")).alias("num_gt_unmatched"),
        (F.col("_np") - F.col("num_pred_matched")).alias("num_pred_unmatched"),
        "mean_matched_iou",
        ((recall >= F.lit(recall_min)) & (precision >= F.lit(precision_min))).alias("exhaustivity_confident"),
        "total_gt_area", "total_pred_area", "unmatched_gt_area", "unmatched_pred_area",
        recall.alias("recall"), precision.alias("precision"),
    )


def stream_conflicts(pairs: DataFrame, sats: DataFrame, policy) -> DataFrame:
    """Best-overlap ground-truth stream of each satellite and the verdict of ``policy``."""
    m = primary_match(pairs, sats)
    ratio_sat = F.coalesce(F.try_divide("overlap_px", "area"), F.lit(0.0))
    out = m.withColumnRenamed("matched_gt_id", "matched_stream_id")
    out = out.withColumn("overlap_ratio_satellite", ratio_sat).withColumn(
        "overlap_ratio_stream", F.coalesce(F.col("overlap_px") / F.col("matched_gt_area"), F.lit(0.0))
    )
    v = policy.decide(F.col("matched_stream_id"), F.col("overlap_ratio_satellite"), F.col("area"),
                      F.col("solidity"), F.col("aspect_sym_moment"))
    return out.withColumn("_v", v).withColumn("decision", F.col("_v.decision")).withColumn(
        "reason", F.col("_v.reason")
    ).drop("_v", "matched_gt_area")


# -- components and optimal assignment ------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node id of the component of each node (large-star / small-star rounds until settled).

    ``edges`` has bigint columns u, v. Only aggregates and joins are used, so a node with very
    many neighbours is combined on the map side and split by adaptive skew joins.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low2.select("u", F.col("m").alias("v")))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _assign(weights: np.ndarray) -> np.ndarray:
    """Column of each row in a maximum-weight assignment (rows <= columns) of whole numbers, shortest paths."""
    n, m = weights.shape
    cost = weights.max() - weights
    row_pot, col_pot = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0] = row
        col = 0
        slack = np.full(m + 1, 1 << 62)
        back = np.zeros(m + 1, dtype=int)
        done = np.zeros(m + 1, dtype=bool)
        while owner[col] != 0:
            done[col] = True
            r = owner[col]
            open_ = np.flatnonzero(~done[1:]) + 1
            reduced = cost[r - 1, open_ - 1] - row_pot[r] - col_pot[open_]
            better = reduced < slack[open_]
            slack[open_[better]] = reduced[better]
            back[open_[better]] = col
            nxt = open_[np.argmin(slack[open_])]
            delta = slack[nxt]
            row_pot[owner[done]] += delta
            col_pot[done] -= delta
            slack[~done] -= delta
            col = nxt
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    out = np.full(n, -1)
    for c in range(1, m + 1):
        if owner[c]:
            out[owner[c] - 1] = c - 1
    return out


def _components_of(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component label of each edge of a small bipartite graph (min-label rounds)."""
    _, ui = np.unique(u, return_inverse=True)
    _, vi = np.unique(v, return_inverse=True)
    lab_u, lab_v = np.arange(ui.max() + 1), np.full(vi.max() + 1, len(u))
    while True:
        np.minimum.at(lab_v, vi, lab_u[ui])
        before = lab_u.copy()
        np.minimum.at(lab_u, ui, lab_v[vi])
        if (before == lab_u).all():
            return lab_u[ui]


def _assign_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Optimal pairs of the edges of one group, component by component."""
    gt, pred, weight, iou = (pdf[c].to_numpy() for c in ("gt_id", "pred_id", "iou", "value"))
    labels = _components_of(gt, pred)
    out_g, out_p, out_w = [], [], []
    for lab in np.unique(labels):
        part = labels == lab
        gts, gi = np.unique(gt[part], return_inverse=True)
        preds, pi = np.unique(pred[part], return_inverse=True)
        w, value = np.zeros((len(gts), len(preds)), np.int64), np.zeros((len(gts), len(preds)))
        w[gi, pi], value[gi, pi] = weight[part], iou[part]
        if min(w.shape) == 1:
            best = np.unravel_index(np.argmax(w), w.shape)
            g, p = np.array([best[0]]), np.array([best[1]])
        else:
            flip = len(gts) > len(preds)
            cols = _assign(w.T if flip else w)
            rows = np.arange(len(cols))
            g, p = (cols, rows) if flip else (rows, cols)
        keep = w[g, p] > 0
        out_g.append(gts[g[keep]])
        out_p.append(preds[p[keep]])
        out_w.append(value[g, p][keep])
    ids = np.concatenate(out_g)
    return pd.DataFrame({"image_id": np.full(len(ids), pdf["image_id"].iloc[0]), "gt_id": ids,
                         "pred_id": np.concatenate(out_p), "iou": np.concatenate(out_w)})


def solve_groups(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``solve_key`` to overlap edges: one key per connected component, at every size, so that a
    crowded image is spread over many tasks."""
    keyed = cut(edges).withColumn("_u", F.xxhash64(F.lit("l"), "image_id", left)).withColumn("_v", F.xxhash64(F.lit("r"), "image_id", right))
    comp = connected_components(keyed.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    return keyed.join(comp.withColumnsRenamed({"node": "_u", "component": "solve_key"}), "_u").drop("_u", "_v")


def _settled(edges: DataFrame) -> DataFrame:
    """Pairs that belong to some optimal assignment for certain.

    If an edge weighs at least as much as the best other edge of its prediction plus the best
    other edge of its ground truth, swapping it in never lowers the total.
    """
    def runner_up(side: str, other: str, name: str) -> DataFrame:
        return two_best(edges, side, other).select(
            "image_id", side, F.col(f"best.{other}").alias(f"_o_{name}"),
            F.coalesce("second_iou", F.lit(0)).alias(f"_w_{name}"))

    both = edges.join(runner_up("pred_id", "gt_id", "a"), ["image_id", "pred_id"]).join(
        runner_up("gt_id", "pred_id", "b"), ["image_id", "gt_id"])
    return both.where("_o_a = gt_id AND _o_b = pred_id AND iou >= _w_a + _w_b").select(*edges.columns)


def pair_weight(iou: Column, gt: Column, pred: Column) -> Column:
    """IoU in whole units of 2^-30, then a number that follows from the ids, small enough that the sum over an
    image's pairs (a label map has at most 255 ids) stays below one unit. So totals are compared exactly, and
    equal ones are told apart in the same way everywhere."""
    return F.floor(iou * F.lit(float(1 << 30))) * F.lit(1 << 20) + F.pmod(F.pmod(gt, F.lit(65_521)) * F.pmod(pred, F.lit(65_521)), F.lit(4093))


def optimal_pairs(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of largest total ``pair_weight`` per image (overlapping pairs only).

    Certain pairs are settled by joins, round by round, until a round settles none; the hard core
    that remains is solved exactly per connected component (see ``solve_groups``), in whole numbers.
    """
    weight = pair_weight(F.col("iou"), F.col("gt_id"), F.col("pred_id")).cast("long")
    edges = cut(pairs.select("image_id", "gt_id", "pred_id", weight.alias("iou"), F.col("iou").alias("value")))
    fixed = edges.where("false")
    while True:
        sure = cut(_settled(edges))
        if sure.isEmpty():
            break
        fixed = fixed.unionByName(sure)
        edges = edges.join(sure.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").join(
            sure.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_anti"
        )
        edges = cut(edges)
    solved = solve_groups(edges, "gt_id", "pred_id").groupBy("solve_key").applyInPandas(
        _assign_group, "image_id long, gt_id long, pred_id long, iou double"
    )
    return fixed.select("image_id", "gt_id", "pred_id", F.col("value").alias("iou")).unionByName(solved)


def optimal_match(pairs: DataFrame, chosen: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per ground truth the optimal pair (kept at ``threshold``) and the best IoU otherwise."""
    best = pairs.groupBy("image_id", "gt_id").agg(F.max("iou").alias("_best"))
    out = (
        gt.withColumnRenamed("inst_id", "gt_id")
        .join(chosen.withColumnRenamed("iou", "_iou"), ["image_id", "gt_id"], "left")
        .join(best, ["image_id", "gt_id"], "left")
    )
    hit = F.coalesce(F.col("_iou") >= F.lit(threshold), F.lit(False))
    return out.select(
        "image_id", "gt_id", "gt_area",
        F.when(hit, F.col("pred_id")).alias("matched_pred_id"),
        F.when(hit, F.col("_iou")).alias("matched_iou"),
        F.when(~hit, F.coalesce("_best", F.lit(0.0))).alias("unmatched_iou"),
        hit.alias("detected"),
    )


def group_by_centroid(points: DataFrame, dist: float = 15.0) -> DataFrame:
    """Transitive proximity groups of centroids per image, numbered by first member.

    Points are gridded by the distance, so only neighbouring cells are compared. Points with
    the same position are first reduced to one, which bounds a cell by its number of positions.
    ``points``: image_id, idx (position in the image), cx, cy.
    """
    spots = points.groupBy("image_id", "cx", "cy").agg(F.min("idx").alias("idx"))
    cells = spots.withColumn("_cx", F.floor(F.col("cx") / dist)).withColumn("_cy", F.floor(F.col("cy") / dist))
    near = cells.select(
        "image_id", F.col("idx").alias("_j"), F.col("cx").alias("_x"), F.col("cy").alias("_y"),
        F.expr("explode(array(_cx - 1, _cx, _cx + 1))").alias("_cx"), "_cy",
    ).withColumn("_cy", F.expr("explode(array(_cy - 1, _cy, _cy + 1))"))
    limit = F.lit(float(dist) * float(dist))
    dx, dy = F.col("cx") - F.col("_x"), F.col("cy") - F.col("_y")
    close = cells.join(near, ["image_id", "_cx", "_cy"]).where((F.col("idx") < F.col("_j")) & (dx * dx + dy * dy <= limit))
    edges = close.select(
        F.xxhash64("image_id", "idx").alias("u"), F.xxhash64("image_id", "_j").alias("v")
    )
    comp = connected_components(edges)
    labelled = spots.withColumn("node", F.xxhash64("image_id", "idx")).join(comp, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    first = labelled.groupBy("image_id", "component").agg(F.min("idx").alias("first_idx"))
    from maskwright.operators.numbering import number_rows

    ranked = number_rows(first, ["image_id"], [F.col("first_idx")], "group_id", start=0)
    spot_group = labelled.join(ranked, ["image_id", "component"]).select("image_id", "cx", "cy", "group_id")
    return points.join(spot_group, ["image_id", "cx", "cy"])


def representatives(masks: DataFrame, area_target: float = 254.0, w_stab: float = 1.0, w_score: float = 1.0,
                    w_aspect: float = 0.3, w_area: float = 0.2) -> DataFrame:
    """Score of each grouped mask and whether it represents its group (first one on ties)."""
    rep: Column = (
        w_stab * F.coalesce("stability_score", F.lit(0.0))
        + w_score * F.coalesce("score", F.lit(0.0))
        - w_aspect * F.abs(F.coalesce("aspect_sym_moment", F.lit(1.0)) - 1.0)
        - w_area * F.abs(F.log(F.greatest("area", F.lit(1))) - F.log(F.lit(max(area_target, 1.0))))
    )
    scored = masks.withColumn("rep_score", rep)
    best = scored.groupBy("image_id", "group_id").agg(
        F.max(F.struct("rep_score", (-F.col("idx")).alias("_i"))).alias("_w")
    ).select("image_id", "group_id", (-F.col("_w._i")).alias("_win"))
    return scored.join(best, ["image_id", "group_id"]).withColumn(
        "reject_reason", F.when(F.col("idx") != F.col("_win"), F.lit("duplicate"))
    ).drop("_win")
