"""Raw against post-processed predictions: links, coverage, rates, dispositions, stage attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.policies import MATCHED, TAXONOMY, UNMATCHED
from maskwright.operators.quantiles import exact_quantiles, with_quantiles

IDENTITY = ["image_id", "raw_index", "candidate_id"]
# Figures summarised for removed and kept candidates.
NUMERIC = ("seed_area", "confidence_score", "matched_gt_area", "overlap_px", "purity", "completeness", "seed_gt_ratio",
           "annulus_excess", "radial_monotonicity", "raw_prediction_score", "raw_prediction_area", "bbox_w", "bbox_h")


def link_post_to_raw(candidates: DataFrame, raw: DataFrame, post: DataFrame) -> DataFrame:
    """Each post prediction with the raw candidate it stems from.

    By mask hash first (of equal hashes the last raw prediction counts), then by identity.
    ``link`` is sha, identity or missing; candidate columns are NULL where missing.
    """
    by_hash = raw.where("candidate_rle_sha1 is not null").groupBy("image_id", "candidate_rle_sha1").agg(
        F.max(F.struct("raw_index", "candidate_id")).alias("_h"))
    ids = candidates.select(*IDENTITY).distinct()
    known = ids.select("image_id", F.col("raw_index").alias("_ri"), F.col("candidate_id").alias("_ci"), F.lit(1).alias("_sha"))
    own = ids.withColumn("_own", F.lit(1))
    out = (
        post.join(by_hash, ["image_id", "candidate_rle_sha1"], "left")
        .withColumn("_ri", F.col("_h.raw_index")).withColumn("_ci", F.col("_h.candidate_id"))
        .join(known, ["image_id", "_ri", "_ci"], "left").join(own, IDENTITY, "left")
    )
    link = F.when(F.col("_sha") == 1, "sha").when(F.col("_own") == 1, "identity").otherwise("missing")
    return out.select(
        "image_id", F.col("raw_index").alias("post_raw_index"), F.col("candidate_id").alias("post_candidate_id"),
        link.alias("link"),
        F.when(link == "sha", F.col("_ri")).when(link == "identity", F.col("raw_index")).alias("raw_index"),
        F.when(link == "sha", F.col("_ci")).when(link == "identity", F.col("candidate_id")).alias("candidate_id"),
    )


def link_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("image_id").agg(
        F.count_if(F.col("link") == "missing").alias("missing_post_links"),
        F.count_if(F.col("link") == "sha").alias("used_sha_links"),
        F.count_if(F.col("link") == "identity").alias("used_identity_links"))


def coverage_from_links(candidates: DataFrame, links: DataFrame, in_scope: Column) -> DataFrame:
    """Candidates and distinct covered ground truths in scope, raw against post, per image."""
    hit = F.col("taxonomy_label").isin(*MATCHED) & F.col("matched_gt_id").isNotNull()
    base = candidates.where(in_scope).withColumn("_hit", hit)
    # Number of post rows linked to a candidate: a candidate may be linked more than once.
    uses = links.where("link <> 'missing'").groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("_uses"))
    rows = base.join(uses, IDENTITY, "left").withColumn("_uses", F.coalesce("_uses", F.lit(0)))
    per_gt = rows.groupBy("image_id", F.when(F.col("_hit"), F.col("matched_gt_id")).alias("_g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_uses").alias("m"), F.count_if("_hit").alias("h"),
        F.sum(F.when(F.col("_hit"), F.col("_uses")).otherwise(0)).alias("hm"))
    return per_gt.groupBy("image_id").agg(
        F.sum("n").alias("raw_candidates_roi"), F.sum("h").alias("matched_candidates_raw"),
        F.count("_g").alias("unique_gt_covered_raw"),
        F.sum("m").alias("post_candidates_roi"), F.sum("hm").alias("matched_candidates_post"),
        F.count_if(F.col("_g").isNotNull() & (F.col("hm") > 0)).alias("unique_gt_covered_post"))


def tradeoff_columns(df: DataFrame) -> DataFrame:
    """Losses, retentions, rates and deltas from counts; undefined rates are NULL."""
    c = F.col

    def div(a: str, b: str) -> Column:
        return F.try_divide(c(a).cast("double"), c(b))

    def diff(a: str, b: str) -> Column:
        return (c(a) - c(b)).cast("double")

    steps = {
        "unique_gt_lost_post": diff("unique_gt_covered_raw", "unique_gt_covered_post"),
        "matched_candidates_removed": diff("matched_candidates_raw", "matched_candidates_post"),
        "unmatched_candidates_removed": diff("unmatched_candidates_raw", "unmatched_candidates_post"),
        "gt_coverage_retention": div("unique_gt_covered_post", "unique_gt_covered_raw"),
        "gt_coverage_loss_rate": div("unique_gt_lost_post", "unique_gt_covered_raw"),
        "matched_candidate_retention": div("matched_candidates_post", "matched_candidates_raw"),
        "matched_candidate_loss_rate": div("matched_candidates_removed", "matched_candidates_raw"),
        "unmatched_candidate_removal_rate": div("unmatched_candidates_removed", "unmatched_candidates_raw"),
        "residual_unmatched_candidate_fraction": div("unmatched_candidates_post", "num_pred_post_roi"),
        "tax_precision_raw": div("matched_candidates_raw", "num_pred_raw_roi"),
        "tax_recall_raw": div("unique_gt_covered_raw", "num_gt_satellites_roi"),
        "tax_precision_post": div("matched_candidates_post", "num_pred_post_roi"),
        "tax_recall_post": div("unique_gt_covered_post", "num_gt_satellites_roi"),
        "delta_tax_precision": diff("tax_precision_post", "tax_precision_raw"),
        "delta_tax_recall": diff("tax_recall_post", "tax_recall_raw"),
    }
    for name, value in steps.items():
        df = df.withColumn(name, value)
    return df


def tradeoff_rows(raw: DataFrame, post: DataFrame) -> DataFrame:
    """One wide row per image from the taxonomy blocks of both layers (official scope)."""
    def side(block: DataFrame, s: str) -> DataFrame:
        cols = [F.col("num_pred").alias(f"num_pred_{s}_roi"), F.col("num_gt").alias(f"_gt_{s}"),
                F.col("unique_gt_covered").alias(f"unique_gt_covered_{s}"),
                F.col("matched_candidates").alias(f"matched_candidates_{s}"),
                F.col("unmatched_candidates").alias(f"unmatched_candidates_{s}"),
                *[F.col(x).alias(f"{x}_{s}") for x in TAXONOMY]]
        if "dice" in block.columns:
            cols.append(F.col("dice").alias(f"pixel_dice_{s}"))
        return block.select("image_id", *cols)

    both = side(raw, "raw").join(side(post, "post"), "image_id")
    both = both.withColumn("num_gt_satellites_roi", F.coalesce("_gt_raw", "_gt_post", F.lit(0)))
    out = tradeoff_columns(both)
    warn = F.array_compact(F.array(
        F.when(F.col("_gt_raw") != F.col("_gt_post"), F.lit("gt_mismatch_between_layers")),
        F.when(F.col("matched_candidates_removed") < 0, F.lit("matched_candidates_removed_negative")),
        F.when(F.col("unmatched_candidates_removed") < 0, F.lit("unmatched_candidates_removed_negative")),
        F.when(F.col("unique_gt_lost_post") < 0, F.lit("unique_gt_lost_post_negative"))))
    return out.withColumn("warnings", F.concat_ws(",", warn)).drop("_gt_raw", "_gt_post")


def tradeoff_rows_from_links(coverage: DataFrame, links: DataFrame, num_gt: DataFrame) -> DataFrame:
    """The same rows for older reports, whose counts come from linked candidates."""
    df = num_gt.select("image_id", F.col("num_gt").alias("num_gt_satellites_roi")).join(coverage, "image_id", "left").join(
        link_counts(links), "image_id", "left").na.fill(0)
    df = df.withColumn("num_pred_raw_roi", F.col("raw_candidates_roi")).withColumn("num_pred_post_roi", F.col("post_candidates_roi"))
    df = df.withColumn("unmatched_candidates_raw", F.col("raw_candidates_roi") - F.col("matched_candidates_raw"))
    df = df.withColumn("unmatched_candidates_post", F.col("post_candidates_roi") - F.col("matched_candidates_post"))
    out = tradeoff_columns(df.drop("raw_candidates_roi", "post_candidates_roi"))
    return out.withColumn("warnings", F.when(F.col("missing_post_links") > 0, F.lit("missing_post_links")).otherwise(F.lit("")))


def paired_scores(rows: DataFrame) -> DataFrame:
    """Paired precision and recall: natural, vacuous (1.0) and excluded samples, and the means."""
    gt, raw, post = F.col("num_gt_satellites_roi"), F.col("num_pred_raw_roi"), F.col("num_pred_post_roi")

    def kind(excluded: Column, vacuous: Column) -> Column:
        return F.when(excluded, "excluded").when(vacuous, "vacuous").otherwise("natural")

    def ratio(num: str, den: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(num).cast("double"), den), F.lit(1.0))

    p_kind = kind(((raw == 0) | (post == 0)) & (gt > 0), (raw == 0) | (post == 0))
    r_kind = kind((gt == 0) & ((raw > 0) | (post > 0)), gt == 0)
    long = rows.select(F.explode(F.array(
        F.struct(F.lit("precision").alias("metric"), p_kind.alias("kind"),
                 ratio("matched_candidates_raw", raw).alias("raw"), ratio("matched_candidates_post", post).alias("post")),
        F.struct(F.lit("recall").alias("metric"), r_kind.alias("kind"),
                 ratio("unique_gt_covered_raw", gt).alias("raw"), ratio("unique_gt_covered_post", gt).alias("post")),
    )).alias("s")).select("s.*")
    used = F.col("kind") != "excluded"
    mean_raw, mean_post = F.avg(F.when(used, F.col("raw"))), F.avg(F.when(used, F.col("post")))
    return long.groupBy("metric").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("natural", "vacuous", "excluded")],
        F.count_if(used).alias("paired"), F.count(F.lit(1)).alias("total"),
        mean_raw.alias("mean_raw"), mean_post.alias("mean_post"), (mean_post - mean_raw).alias("delta_mean"))


# Columns summed and rates described by the overall summary.
TOTALS = ("matched_candidates_raw", "unmatched_candidates_raw", "matched_candidates_post", "unmatched_candidates_post",
          "matched_candidates_removed", "unmatched_candidates_removed", "num_pred_raw_roi", "num_pred_post_roi",
          "unique_gt_covered_raw", "unique_gt_covered_post", "unique_gt_lost_post")
RATES = ("matched_candidate_loss_rate", "unmatched_candidate_removal_rate", "residual_unmatched_candidate_fraction",
         "gt_coverage_loss_rate", "gt_coverage_retention", "tax_precision_raw", "tax_recall_raw",
         "tax_precision_post", "tax_recall_post", "delta_tax_precision", "delta_tax_recall")


def tradeoff_summary(rows: DataFrame) -> DataFrame:
    """One row of totals and pooled scores over all samples."""
    out = rows.agg(F.count(F.lit(1)).alias("n_samples"), *[F.sum(c).cast("long").alias(c) for c in TOTALS],
                   F.sum("num_gt_satellites_roi").alias("num_gt"))
    for s in ("raw", "post"):
        out = out.withColumn(f"micro_precision_{s}", F.try_divide(f"matched_candidates_{s}", f"num_pred_{s}_roi")).withColumn(
            f"micro_recall_{s}", F.try_divide(f"unique_gt_covered_{s}", "num_gt"))
    return out


def numeric_stats(rows: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """valid, omitted, mean, median, population deviation, min and max of each field, one row each."""
    stack = ", ".join(f"'{f}', cast({f} as double)" for f in fields)
    long = rows.select(*by, F.expr(f"stack({len(fields)}, {stack}) as (field, value)"))
    out = long.groupBy(*by, "field").agg(
        F.count("value").alias("valid"), (F.count(F.lit(1)) - F.count("value")).alias("omitted"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return with_quantiles(out, long, [*by, "field"], "value", {"median": 0.5})


def count_by_key(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per value as text (NULL is 'null'), largest first."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return rows.groupBy(*by, text.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, F.col("n").desc(), "key")


def dispositions(candidates: DataFrame, links: DataFrame, in_scope: Column, matched: bool = True) -> DataFrame:
    """Candidates in scope of the matched (or unmatched) classes with kept or removed."""
    labels = MATCHED if matched else UNMATCHED
    rows = candidates.where(in_scope & F.col("taxonomy_label").isin(*labels))
    if matched:
        rows = rows.where("matched_gt_id is not null")
    kept = links.where("link <> 'missing'").select(*IDENTITY).distinct().withColumn("_k", F.lit(True))
    out = rows.join(kept, IDENTITY, "left").withColumn("kept_in_post", F.coalesce("_k", F.lit(False))).drop("_k")
    return out.withColumn("post_status", F.when(F.col("kept_in_post"), "kept").otherwise("removed"))


def disposition_groups(rows: DataFrame, keys: Sequence[str] = ("taxonomy_label", "label_reason")) -> DataFrame:
    """Raw, kept and removed counts and the removal rate by each key."""
    stack = ", ".join(f"'{k}', {k}" for k in keys)
    long = rows.select("kept_in_post", F.expr(f"stack({len(keys)}, {stack}) as (grouping, key)"))
    return long.groupBy("grouping", "key").agg(
        F.count(F.lit(1)).alias("raw_total"), F.count_if("kept_in_post").alias("kept"),
        F.count_if(~F.col("kept_in_post")).alias("removed")).withColumn("removal_rate", F.col("removed") / F.col("raw_total"))


def removed_matched(rows: DataFrame) -> DataFrame:
    """Groups of removed matched candidates; ground-truth ids are pooled across samples."""
    gone = rows.where("NOT kept_in_post")
    keyed = gone.select("matched_gt_id", "is_one_to_one", F.expr(
        "stack(3, 'all', 'all', 'taxonomy_label', taxonomy_label, 'label_reason', label_reason) as (grouping, key)"))
    per_gt = keyed.groupBy("grouping", "key", "matched_gt_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_one_to_one").alias("o"))
    out = per_gt.groupBy("grouping", "key").agg(
        F.sum("n").alias("removed"), F.count("matched_gt_id").alias("unique_matched_gt_ids"),
        F.sum("o").alias("one_to_one"))
    total = out.where("grouping = 'all'").agg(F.max("removed").alias("_t")).withColumn("_j", F.lit(1))
    # The total is a single row, so the broadcast is bounded.
    return out.withColumn("_j", F.lit(1)).join(F.broadcast(total), "_j", "left").select(
        "grouping", "key", "removed", (F.col("removed") / F.col("_t")).alias("fraction"), "unique_matched_gt_ids", "one_to_one")


def removed_per_sample(rows: DataFrame) -> DataFrame:
    gone = rows.where("NOT kept_in_post")
    per_gt = gone.groupBy("image_id", "matched_gt_id").agg(F.count(F.lit(1)).alias("n"))
    return per_gt.groupBy("image_id").agg(
        F.sum("n").alias("n_removed_matched_candidates"), F.count("matched_gt_id").alias("unique_removed_matched_gt_ids")
    ).orderBy(F.col("n_removed_matched_candidates").desc(), "image_id")


def join_stage_trace(rows: DataFrame, trace: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Dispositions with their stage trace by identity, one outcome and reason column per stage."""
    t = trace.select(*IDENTITY, F.col("candidate_rle_sha1").alias("_sha"), "first_drop_stage", "first_drop_reason", "stage_results")
    by_stage = F.map_from_entries(F.transform("stage_results", lambda r: F.struct(r["stage"], r)))
    out = rows.join(t, IDENTITY).withColumn("_m", by_stage)
    for s in stages:
        out = out.withColumn(f"{s}_outcome", F.col("_m")[s]["outcome"]).withColumn(f"{s}_reason", F.col("_m")[s]["reason"])
    return out.withColumn("sha_mismatch", F.coalesce(F.col("candidate_rle_sha1") != F.col("_sha"), F.lit(False))).drop("_m", "_sha", "stage_results")


def stage_attribution(rows: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Entered, dropped, survived and conditional drop rate of each stage, overall and by class."""
    stack = ", ".join(f"'{s}', {s}_outcome" for s in stages)
    long = rows.select("taxonomy_label", "label_reason", F.expr(f"stack({len(stages)}, {stack}) as (stage, outcome)"))
    keyed = long.select("stage", "outcome", F.expr(
        "stack(3, 'all', 'all', 'taxonomy_label', taxonomy_label, 'label_reason', label_reason) as (grouping, key)"))
    out = keyed.groupBy("grouping", "key", "stage").agg(
        F.count_if(F.col("outcome").isin("pass", "rescue", "drop")).alias("entered"),
        F.count_if(F.col("outcome") == "drop").alias("dropped"))
    return out.withColumn("survived_stage", F.col("entered") - F.col("dropped")).withColumn(
        "conditional_drop_rate", F.try_divide("dropped", "entered"))


# -- shape statistics over instances -------------------------------------------------------

# Quantiles and figures of the shape summary.
QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
SHAPE_METRICS = ("area", "bbox_w", "bbox_h", "aspect_sym_moment", "aspect_sym_boundary", "curvature_ratio",
                 "extent", "perimeter", "solidity", "circularity")


def mask_stats_summary(stats: DataFrame, metrics: Sequence[str] = SHAPE_METRICS) -> DataFrame:
    """Seven quantiles of each figure by (type, threshold) and by type alone (threshold NULL)."""
    present = [m for m in metrics if m in stats.columns]
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in present)
    long = stats.select("feature_type", "sb_threshold", F.expr(f"stack({len(present)}, {stack}) as (metric, value)"))
    long = long.withColumn("sb_threshold", F.explode(F.array("sb_threshold", F.lit(None).cast("double"))))
    # Counted values first: quantiles then work on (value, frequency).
    hist = long.where("value is not null").groupBy("feature_type", "sb_threshold", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    names = {f"p{int(round(q * 100)):02d}": q for q in QUANTILES}
    keys = ["feature_type", "sb_threshold", "metric"]
    out = with_quantiles(hist.groupBy(*keys).agg(F.sum("n").alias("n")), hist, keys, "value", names, weight="n")
    return out.select(*keys, "n", *[F.round(c, 4).alias(c) for c in names])


def filter_recommendations(summary: DataFrame) -> DataFrame:
    """Thresholds from the type-wide 1st and 99th percentiles; a missing ratio becomes 999."""
    def pick(metric: str, q: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(q)))

    far = F.lit(999.0)
    return summary.where("sb_threshold is null").groupBy("feature_type").agg(
        pick("area", "p01").alias("min_area"), pick("area", "p99").alias("max_area"),
        pick("solidity", "p01").alias("min_solidity"),
        F.coalesce(pick("aspect_sym_moment", "p99"), far).alias("aspect_sym_moment_max"),
        F.coalesce(pick("aspect_sym_boundary", "p99"), far).alias("aspect_sym_boundary_max"),
        F.coalesce(pick("curvature_ratio", "p99"), far).alias("curvature_ratio_p99"),
        F.max(F.when(F.col("metric") == "area", F.col("n"))).alias("n_instances"))


def metric_trends(stats: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Median of each figure by type and threshold; axis ratios above 100 are left out first."""
    for c in ("aspect_sym_boundary", "aspect_sym_moment", "aspect_sym"):
        if c in stats.columns:
            stats = stats.withColumn(c, F.when(F.col(c) <= 100, F.col(c)))
    keys = ["feature_type", "sb_threshold"]
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = stats.select(*keys, F.expr(f"stack({len(metrics)}, {stack}) as (metric, value)"))
    q = exact_quantiles(long, [*keys, "metric"], "value", {"median": 0.5})
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(m) for m in metrics])
    every = stats.select(*keys).distinct().withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [every[f"_{k}"].eqNullSafe(wide[k]) for k in keys]
    return every.join(wide, same, "left").select(*[F.col(f"_{k}").alias(k) for k in keys], *metrics)
