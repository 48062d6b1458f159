"""Scores: pixel and detection blocks, micro and macro averages, precision-recall curves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maskwright.functions.policies import MATCHED, TAXONOMY, UNMATCHED
from maskwright.operators.numbering import running_sums
from maskwright.operators.tiles import inner_boundary, side_counts, tile_rows
from maskwright.operators.quantiles import with_quantiles
from maskwright.session import cut

FEATURES = ("purity", "completeness", "seed_gt_ratio", "annulus_excess", "radial_monotonicity")


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean; NULL if a side is NULL, 0 if both are 0."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def pixel_counts(pred: DataFrame, gt: DataFrame, units: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """tp, fp, fn of the unions of both sides for every row of ``units``."""
    keys = list(keys)
    counts = side_counts(pred, gt, keys).withColumnsRenamed({"both": "tp", "only_a": "fp", "only_b": "fn"})
    return units.select(*keys).distinct().join(counts, keys, "left").na.fill(0, ["tp", "fp", "fn"])


def pixel_scores(counts: DataFrame) -> DataFrame:
    """Dice, precision and recall; NULL where a needed side is empty."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("dice", F.try_divide(2 * tp, 2 * tp + fp + fn))
        .withColumn("pixel_precision", F.try_divide(tp, tp + fp))
        .withColumn("pixel_recall", F.try_divide(tp, tp + fn))
    )


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each point (y, x) of ``a`` to its nearest point of ``b`` (not empty).

    Rows of ``b`` are searched outwards from each point's own row, in each the nearest column on both sides, until
    the row itself is further away than the best point so far.
    """
    wide = int(max(a[:, 1].max(initial=0), b[:, 1].max())) + 2
    keys = np.unique(b[:, 0] * wide + b[:, 1])
    best = np.full(len(a), np.iinfo(np.int64).max)
    live, step = np.arange(len(a)), 0
    low, high = int(b[:, 0].min()), int(b[:, 0].max())
    while len(live):
        for sign in (-1, 1)[: 2 if step else 1]:
            row = a[live, 0] + sign * step
            at = np.searchsorted(keys, row * wide + a[live, 1])
            for side in (at - 1, at):
                found = keys[np.clip(side, 0, len(keys) - 1)]
                gap = found % wide - a[live, 1]
                ok = found // wide == row
                best[live[ok]] = np.minimum(best[live[ok]], step * step + gap[ok] * gap[ok])
        step += 1
        y = a[live, 0]
        live = live[(step * step < best[live]) & ((y - step >= low) | (y + step <= high))]
    return best


def hausdorff95(pred: DataFrame, gt: DataFrame, images: DataFrame, height: int, width: int) -> DataFrame:
    """Larger of the two 95th percentiles of boundary distances per image.

    NULL if both sides are empty, the frame diagonal if one is. The boundaries of both unions reach an image's task as
    64-bit tile rows, so it holds at most two bit sets of the frame and their points.
    """
    keys = ["image_id"]
    edges = [inner_boundary(tile_rows(runs, keys), keys).withColumn("side", F.lit(k)) for k, runs in enumerate((pred, gt))]
    kind = images.schema["image_id"].dataType.simpleString()

    def percentiles(table: pa.Table) -> pa.Table:
        side, y, tile = (table.column(c).to_numpy().astype(np.int64) for c in ("side", "y", "tile"))
        bits = np.unpackbits(table.column("bits").to_numpy().astype("<i8").view(np.uint8), bitorder="little").reshape(-1, 64)
        row, k = np.nonzero(bits)
        points = np.stack([y[row], tile[row] * 64 + k], axis=1)
        sides = [points[side[row] == s] for s in (0, 1)]
        d = None
        if len(sides[0]) and len(sides[1]):
            d = max(float(np.percentile(np.sqrt(squared_distances(u, v).astype(float)), 95)) for u, v in (sides, sides[::-1]))
        return pa.table({"image_id": table.column("image_id").slice(0, 1), "_d": pa.array([d], pa.float64())})

    far = edges[0].unionByName(edges[1]).groupBy(*keys).applyInArrow(percentiles, f"image_id {kind}, _d double")
    out = images.select("image_id").distinct().join(far.withColumn("_any", F.lit(True)), "image_id", "left")
    diagonal = float((height * height + width * width) ** 0.5)
    return out.select("image_id", F.when(F.col("_any"), F.coalesce("_d", F.lit(diagonal))).alias("capped_hausdorff95"))


# -- blocks ---------------------------------------------------------------------------


def _empty_rules(p: Column, r: Column, f: Column) -> tuple[Column, Column, Column]:
    none = F.lit(None).cast("double")
    no_gt, no_pred = F.col("num_gt") == 0, F.col("num_pred") == 0
    both = no_gt & no_pred
    return (
        F.when(both, 1.0).when(no_gt, 0.0).when(no_pred, none).otherwise(p),
        F.when(both, 1.0).when(no_gt, none).when(no_pred, 0.0).otherwise(r),
        F.when(both, 1.0).when(no_gt | no_pred, none).otherwise(f),
    )


def taxonomy_block(candidates: DataFrame, num_gt: DataFrame, units: DataFrame | None = None,
                   keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Counts and precision, recall, F1 of classified candidates for every row of ``units``.

    ``num_gt``: keys + num_gt; without ``units`` its rows are the units. Distinct covered ground
    truths are counted once per key.
    """
    keys = list(keys)
    hit = F.col("taxonomy_label").isin(*MATCHED)
    # One pass: first per covered ground truth, so that the distinct count becomes a plain count.
    per = candidates.groupBy(*keys, F.when(hit, F.col("matched_gt_id")).alias("_g")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(hit).alias("_m"),
        *[F.count_if(F.col("taxonomy_label") == label).alias(label) for label in TAXONOMY])
    agg = per.groupBy(*keys).agg(
        F.sum("_n").alias("num_pred"), F.sum("_m").alias("matched_candidates"), F.count("_g").alias("unique_gt_covered"),
        *[F.sum(label).alias(label) for label in TAXONOMY])
    out = num_gt.select(*keys, "num_gt")
    if units is not None:
        out = units.select(*keys).distinct().join(out, keys, "left")
    out = out.join(agg, keys, "left").na.fill(0)
    p = F.try_divide("matched_candidates", "num_pred")
    r = F.try_divide("unique_gt_covered", "num_gt")
    ep, er, ef = _empty_rules(p, r, f1(p, r))
    return out.select(
        *keys, "num_gt", "num_pred", "matched_candidates",
        (F.col("num_pred") - F.col("matched_candidates")).alias("unmatched_candidates"),
        "unique_gt_covered",
        F.greatest(F.lit(0), F.col("num_gt") - F.col("unique_gt_covered")).alias("gt_uncovered"),
        ep.alias("precision"), er.alias("recall"), ef.alias("f1"), *TAXONOMY,
        ((F.col("num_gt") == 0) & (F.col("num_pred") == 0)).alias("is_empty_trivial"),
    )


def detection_block(per_gt: DataFrame, num_pred: DataFrame, units: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Detection counts and scores from an optimal match (see ``optimal_match``)."""
    keys = list(keys)
    agg = per_gt.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_gt"), F.count_if("detected").alias("tp"),
        F.avg("matched_iou").alias("matched_iou_mean"),
        F.median("matched_iou").alias("matched_iou_median"),
    )
    out = units.select(*keys).distinct().join(agg, keys, "left").join(
        num_pred.select(*keys, "num_pred"), keys, "left"
    ).na.fill(0, ["num_gt", "tp", "num_pred"])
    out = out.withColumn("fp", F.col("num_pred") - F.col("tp")).withColumn("fn", F.col("num_gt") - F.col("tp"))
    p, r = F.try_divide("tp", "num_pred"), F.try_divide("tp", "num_gt")
    ep, er, ef = _empty_rules(p, r, f1(p, r))
    return out.select(
        *keys, "num_gt", "num_pred", "tp", "fp", "fn",
        ep.alias("precision"), er.alias("recall"), ef.alias("f1"),
        "matched_iou_mean", "matched_iou_median",
        ((F.col("num_gt") == 0) & (F.col("num_pred") == 0)).alias("is_empty_trivial"),
    )


def detection_micro(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = blocks.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    ok = (p > 0) & (r > 0)
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(ok, f1(p, r)))


def taxonomy_micro(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cols = ("matched_candidates", "unmatched_candidates", "num_pred", "unique_gt_covered", "num_gt")
    out = blocks.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    p, r = F.try_divide("matched_candidates", "num_pred"), F.try_divide("unique_gt_covered", "num_gt")
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(p, r))


def macro(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over the samples where a score is defined, with the numbers of samples used."""
    return blocks.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("precision", "recall", "f1")],
        *[F.count(c).alias(f"{c}_samples") for c in ("precision", "recall", "f1")],
        F.count(F.lit(1)).alias("samples_total"),
    )


def label_counts(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    return candidates.groupBy(*by).agg(
        *[F.count_if(F.col("taxonomy_label") == label).alias(label) for label in TAXONOMY]
    )


def diagnostics_features(candidates: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """n, min, quartiles and max of each feature per matching class; every class appears."""
    long = candidates.select("taxonomy_label", F.expr(
        f"stack({len(features)}, " + ", ".join(f"'{f}', cast({f} as double)" for f in features) + ") as (feature, value)"
    )).where("value is not null")
    agg = long.groupBy("taxonomy_label", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"),
    )
    agg = with_quantiles(agg, long, ["taxonomy_label", "feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    frame = candidates.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in TAXONOMY])).alias("taxonomy_label")
    ).withColumn("feature", F.explode(F.array(*[F.lit(x) for x in features])))
    return frame.join(agg, ["taxonomy_label", "feature"], "left").select(
        "taxonomy_label", "feature", F.coalesce("n", F.lit(0)).alias("n"), "v_min",
        "p25", "median", "p75", "v_max",
    )


def matched_rollup(counts: DataFrame) -> DataFrame:
    """Collapse class counts (one row per stage: raw, post) into matched and unmatched numbers."""
    def total(stage: str, labels: tuple[str, ...]) -> Column:
        return F.sum(F.when(F.col("stage") == stage, sum((F.col(x) for x in labels), F.lit(0))))

    return counts.agg(
        total("raw", MATCHED).alias("matched_raw"), total("raw", UNMATCHED).alias("unmatched_raw"),
        total("post", MATCHED).alias("matched_post"), total("post", UNMATCHED).alias("unmatched_post"),
    )


# -- precision-recall -----------------------------------------------------------------


def pr_points(scored: DataFrame, n_gt: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score, missed ground truths padded at score -1.

    ``scored``: keys, score, is_tp. ``n_gt``: keys, num_gt. Rows are reduced to distinct
    scores before the cumulative sums, which are spread over score ranges.
    """
    names, keys = list(keys), list(keys) or ["_all"]
    if not names:
        # One group in all: its totals are a single row, hence the small side of each join.
        scored, n_gt = scored.withColumn("_all", F.lit(0)), n_gt.withColumn("_all", F.lit(0))
    one = (lambda d: d) if names else F.broadcast
    # A few rows per group, read five times below (range bounds, ranges, totals): written once, so that what
    # they come from is computed once.
    at_score = cut(scored.groupBy(*keys, "score").agg(
        F.sum(F.col("is_tp").cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")
    ))
    hits = at_score.groupBy(*keys).agg(F.sum("tp").alias("_tp"))
    base = n_gt.join(one(hits), keys, "left")
    phantom = base.select(
        *keys, F.lit(-1.0).alias("score"),
        F.greatest(F.col("num_gt") - F.coalesce("_tp", F.lit(0)), F.lit(0)).alias("tp"),
    ).withColumn("n", F.col("tp")).where("tp > 0")
    rows = cut(at_score.unionByName(phantom))
    total = rows.groupBy(*keys).agg(F.sum("tp").alias("_pos"))
    cum = running_sums(rows, keys, [F.col("score").desc()], {"cum_tp": "tp", "cum_n": "n"})
    return cum.join(one(total), keys).where("_pos > 0").select(
        *names, F.col("score").alias("threshold"), "tp",
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
        (F.col("cum_tp") / F.col("_pos")).alias("recall"),
        F.col("_pos").alias("positives"),
    )


def average_precision(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of precision over recall steps; a step equals tp at that score over all positives."""
    return points.groupBy(*keys).agg(
        F.sum(F.col("tp") / F.col("positives") * F.col("precision")).alias("average_precision")
    )


def pr_curve(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Curve points with the closing (recall 0, precision 1) point without threshold."""
    pts = points.select(*keys, "threshold", "precision", "recall")
    end = pts.select(*keys).distinct() if keys else pts.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
    end = end.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


# Thresholds at which the coarse table is read, and the swept gate values.
GRID = (0.18, 0.30, 0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)
SWEEP = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
         0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def threshold_table(points: DataFrame) -> DataFrame:
    return points.select(
        F.col("threshold").alias("confidence_threshold"), "precision", "recall",
        f1(F.col("precision"), F.col("recall")).alias("f1"),
    ).where("confidence_threshold is not null")


def threshold_picks(table: DataFrame, min_precision: float = 0.90, min_recall: float = 0.90) -> DataFrame:
    """Grid look-ups (first threshold at or above), best F1, and the feasible window.

    One pass of min_by / max_by aggregates; a pick that does not exist has NULL figures.
    """
    t = F.col("confidence_threshold")
    row = F.struct("confidence_threshold", "precision", "recall", "f1")
    ok = (F.col("precision") >= F.lit(min_precision)) & (F.col("recall") >= F.lit(min_recall))

    def least(cond: Column, order: Column) -> Column:
        return F.min_by(row, F.when(cond, order))

    def most(cond: Column, order: Column) -> Column:
        return F.max_by(row, F.when(cond, order))

    yes = F.lit(True)
    picks = {f"grid_{g:.2f}": least(t >= F.lit(g), t) for g in GRID}
    picks["best_f1"] = most(yes, F.struct("f1", -t))
    picks["feasible_lowest"] = least(ok, t)
    picks["feasible_highest"] = most(ok, t)
    picks["feasible_best_f1"] = most(ok, F.struct("f1", -t))
    none = F.count_if(ok) == 0
    picks["fallback_best_precision"] = F.when(none, most(yes, F.struct("precision", "recall", -t)))
    picks["fallback_best_recall"] = F.when(none, most(yes, F.struct("recall", "precision", -t)))
    one = table.agg(*[v.alias(k) for k, v in picks.items()])
    names = list(picks)
    long = one.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (pick, r)"))
    return long.select("pick", "r.confidence_threshold", "r.precision", "r.recall", "r.f1")


def step_auc(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under (recall, precision) points by steps, over a short list of settings."""
    w = W.partitionBy(*by).orderBy("recall", "threshold")
    step = F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    return rows.where("precision is not null and recall is not null").withColumn(
        "_a", step * F.col("precision")
    ).groupBy(*by).agg(F.sum("_a").alias("auc_pr"))


def pixel_summary(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means and deviations over images, scores from summed counts, and numbers of empty sides."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    means = [c for c in ("dice", "pixel_precision", "pixel_recall", "capped_hausdorff95", "matched_iou", "instance_recall") if c in blocks.columns]
    return blocks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"),
        *[F.avg(c).alias(f"{c}_mean") for c in means],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in means],
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("micro_dice"),
        F.try_divide(tp, tp + fp).alias("micro_precision"),
        F.try_divide(tp, tp + fn).alias("micro_recall"),
        F.count_if(F.col("tp") + F.col("fp") == 0).alias("n_empty_pred"),
        F.count_if(F.col("tp") + F.col("fn") == 0).alias("n_empty_gt"),
    )
