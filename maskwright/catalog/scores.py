"""Named queries: blocks, averages, curves, trade-off tables, shape statistics."""

from pyspark.sql import functions as F

from maskwright.catalog import query
from maskwright.catalog.matching import _UNIONS, optimal_ctes
from maskwright.catalog.rules import CFG, CORE, GATE, PRIOR, RULES, trace
from maskwright.functions.policies import TAXONOMY, Taxonomy
from maskwright.operators import match, runs as R, score, shape, tradeoff
from maskwright.plans import post
from maskwright.plans.fixtures import ROI, SIDE
from maskwright.operators.quantiles import with_quantiles
from maskwright.session import held

_PIX = """
    SELECT image_id, tp, fp, fn, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS dice, tp::DOUBLE / nullif(tp + fp, 0) AS pixel_precision,
           tp::DOUBLE / nullif(tp + fn, 0) AS pixel_recall FROM px_counts"""


@query("a1_pixel_metrics", _PIX, doubles="dice pixel_precision pixel_recall", ctes=_UNIONS)
def _(t):
    return score.pixel_scores(score.pixel_counts(t.pred_runs, t.gt_runs, t.images))


@query("a2_hausdorff95", """
    SELECT image_id, CASE WHEN p.n IS NULL AND g.n IS NULL THEN NULL WHEN p.n IS NULL OR g.n IS NULL THEN sqrt(131072::DOUBLE)
           ELSE greatest(a.q, b.q) END AS capped_hausdorff95
    FROM images LEFT JOIN (SELECT image_id, count(*) AS n FROM edge_p GROUP BY ALL) p USING (image_id)
    LEFT JOIN (SELECT image_id, count(*) AS n FROM edge_g GROUP BY ALL) g USING (image_id)
    LEFT JOIN (SELECT image_id, quantile_cont(sqrt(d2), 0.95) AS q FROM (
        SELECT image_id, e.y, e.x, min((e.y - f.y) * (e.y - f.y) + (e.x - f.x) * (e.x - f.x))::DOUBLE AS d2 FROM edge_p e JOIN edge_g f USING (image_id) GROUP BY ALL) GROUP BY ALL) a USING (image_id)
    LEFT JOIN (SELECT image_id, quantile_cont(sqrt(d2), 0.95) AS q FROM (
        SELECT image_id, e.y, e.x, min((e.y - f.y) * (e.y - f.y) + (e.x - f.x) * (e.x - f.x))::DOUBLE AS d2 FROM edge_g e JOIN edge_p f USING (image_id) GROUP BY ALL) GROUP BY ALL) b USING (image_id)""",
    doubles="capped_hausdorff95", ctes={
        "ups": "SELECT DISTINCT image_id, y, x FROM pred_px WHERE type_label = 'satellites'",
        "ugs": "SELECT DISTINCT image_id, y, x FROM gt_px WHERE type_label = 'satellites'",
        "edge_p": """SELECT * FROM ups p WHERE (SELECT count(*) FROM ups q WHERE q.image_id = p.image_id AND
            ((q.y = p.y AND q.x = p.x - 1) OR (q.y = p.y AND q.x = p.x + 1) OR (q.y = p.y - 1 AND q.x = p.x) OR (q.y = p.y + 1 AND q.x = p.x))) < 4""",
        "edge_g": """SELECT * FROM ugs p WHERE (SELECT count(*) FROM ugs q WHERE q.image_id = p.image_id AND
            ((q.y = p.y AND q.x = p.x - 1) OR (q.y = p.y AND q.x = p.x + 1) OR (q.y = p.y - 1 AND q.x = p.x) OR (q.y = p.y + 1 AND q.x = p.x))) < 4"""})
def _(t):
    return score.hausdorff95(t.pred_of("satellites"), t.gt_of("satellites"), t.images, SIDE, SIDE)


@query("a3_cover_ratios", "SELECT image_id, inst_id AS pred_id, purity, completeness, seed_gt_ratio FROM one2one",
       doubles="purity completeness seed_gt_ratio")
def _(t):
    m = match.primary_match(t.sat_pairs, t.sats.select("image_id", "inst_id", "area"))
    return match.cover_ratios(m).select("image_id", "pred_id", "purity", "completeness", "seed_gt_ratio")


@query("a4_taxonomy", "SELECT image_id, inst_id AS pred_id, taxonomy_label, label_reason, is_one_to_one, intersects_roi FROM candidates")
def _(t):
    return t.candidates.select("image_id", "pred_id", "taxonomy_label", "label_reason", "is_one_to_one", "intersects_roi")


_BLOCK = """
    SELECT i.image_id, scope, num_gt, num_pred, matched_candidates, num_pred - matched_candidates AS unmatched_candidates, unique_gt_covered,
           greatest(0, num_gt - unique_gt_covered) AS gt_uncovered,
           CASE WHEN num_gt = 0 AND num_pred = 0 THEN 1 WHEN num_gt = 0 THEN 0 WHEN num_pred = 0 THEN NULL ELSE matched_candidates::DOUBLE / num_pred END AS precision,
           CASE WHEN num_gt = 0 AND num_pred = 0 THEN 1 WHEN num_gt = 0 THEN NULL WHEN num_pred = 0 THEN 0 ELSE unique_gt_covered::DOUBLE / num_gt END AS recall,
           CASE WHEN num_gt = 0 AND num_pred = 0 THEN 1 WHEN num_gt = 0 OR num_pred = 0 THEN NULL WHEN matched_candidates + unique_gt_covered = 0 THEN 0
                ELSE 2 * (matched_candidates::DOUBLE / num_pred) * (unique_gt_covered::DOUBLE / num_gt) / (matched_candidates::DOUBLE / num_pred + unique_gt_covered::DOUBLE / num_gt) END AS f1,
           compact_complete, diffuse_core, reject_unmatched, reject_low_purity, num_gt = 0 AND num_pred = 0 AS is_empty_trivial
    FROM (SELECT s.image_id, s.scope, CASE WHEN s.scope = 'roi' THEN s.num_gt_roi ELSE s.num_gt END AS num_gt, count(c.inst_id) AS num_pred,
           count(c.inst_id) FILTER (taxonomy_label IN ('compact_complete', 'diffuse_core')) AS matched_candidates,
           count(DISTINCT matched_gt_id) FILTER (taxonomy_label IN ('compact_complete', 'diffuse_core')) AS unique_gt_covered,
           count(c.inst_id) FILTER (taxonomy_label = 'compact_complete') AS compact_complete, count(c.inst_id) FILTER (taxonomy_label = 'diffuse_core') AS diffuse_core,
           count(c.inst_id) FILTER (taxonomy_label = 'reject_unmatched') AS reject_unmatched, count(c.inst_id) FILTER (taxonomy_label = 'reject_low_purity') AS reject_low_purity
         FROM (SELECT *, unnest(['full_frame', 'roi']) AS scope FROM num_gt) s
         LEFT JOIN {cands} c ON c.image_id = s.image_id AND (s.scope = 'full_frame' OR c.intersects_roi) GROUP BY s.image_id, s.scope, s.num_gt, s.num_gt_roi) i"""

# Survivors of the gate, classified again: only the one-to-one flag depends on who is left.
_POST = {
    **RULES,
    "post_one": """
    SELECT o.* EXCLUDE (is_one_to_one), matched_gt_id IS NOT NULL AND row_number() OVER (PARTITION BY image_id, matched_gt_id ORDER BY overlap_px DESC, inst_id) = 1 AS is_one_to_one
    FROM one2one o JOIN (SELECT image_id, inst_id FROM gated WHERE gate_reason LIKE 'pass%') g USING (image_id, inst_id)""",
    "post_candidates": """
    SELECT *, CASE WHEN matched_gt_id IS NULL THEN 'reject_unmatched'
                 WHEN completeness >= 0.95::DOUBLE AND is_one_to_one AND seed_gt_ratio <= 3 THEN 'compact_complete'
                 WHEN purity < 0.5::DOUBLE THEN 'reject_low_purity'
                 WHEN completeness >= 0.5::DOUBLE THEN 'compact_complete' ELSE 'diffuse_core' END AS taxonomy_label FROM post_one""",
    "raw_blocks": _BLOCK.format(cands="candidates"),
    "post_blocks": _BLOCK.format(cands="post_candidates"),
}
_CTES = {**_UNIONS, **_POST}


def gated(t):
    v = GATE.decide(F.col("area"), F.col("score"))
    return t.sats.where(v["decision"] == "pass").withColumn("raw_index", F.col("inst_id"))


def post_candidates(t):
    """Classified satellites that pass the gate; overlaps with the dropped ones are not needed."""
    return match.classify_candidates(t.sat_hits, gated(t), roi=ROI)


def num_gt(t):
    inside = F.expr("cy >= 32 and cy < 224 and cx >= 32 and cx < 224")
    n = t.gt_m.where("type_label = 'satellites'").groupBy("image_id").agg(F.count(F.lit(1)).alias("full_frame"), F.count_if(inside).alias("roi"))
    both = t.images.join(n, "image_id", "left").na.fill(0)
    return both.select("image_id", F.expr("stack(2, 'full_frame', full_frame, 'roi', roi) as (scope, num_gt)"))


def blocks(t, candidates):
    scoped = candidates.withColumn("scope", F.explode(F.when(F.col("intersects_roi"), F.array(F.lit("full_frame"), F.lit("roi"))).otherwise(F.array(F.lit("full_frame")))))
    return score.taxonomy_block(scoped, num_gt(t), keys=("image_id", "scope"))


@query("a6_taxonomy_block", "SELECT * FROM raw_blocks", doubles="precision recall f1", ctes=_CTES)
def _(t):
    return blocks(t, t.candidates)


def _detections(gt_in_roi: str) -> dict[str, str]:
    """Detection blocks of streams in both scopes; ``gt_in_roi`` says which ground truths belong to the ROI."""
    pred_in_roi = "cy >= 32 AND cy < 224 AND cx >= 32 AND cx < 224"
    return {
        **optimal_ctes("""
    SELECT e.scope, e.image_id, e.pred_id, e.gt_id, iou FROM (SELECT *, unnest(['full_frame', 'roi']) AS scope FROM pairs WHERE pred_type = 'tidal_features' AND gt_type = 'tidal_features') e
    JOIN scoped_pred p ON p.scope = e.scope AND p.image_id = e.image_id AND p.pred_id = e.pred_id JOIN scoped_gt g ON g.scope = e.scope AND g.image_id = e.image_id AND g.gt_id = e.gt_id"""),
        "scoped_pred": f"SELECT scope, image_id, inst_id AS pred_id FROM (SELECT *, unnest(['full_frame', 'roi']) AS scope FROM pred_m WHERE type_label = 'tidal_features') WHERE scope = 'full_frame' OR ({pred_in_roi})",
        "scoped_gt": f"SELECT scope, image_id, inst_id AS gt_id, area AS gt_area FROM (SELECT *, unnest(['full_frame', 'roi']) AS scope FROM gt_m WHERE type_label = 'tidal_features') m WHERE scope = 'full_frame' OR ({gt_in_roi})",
        "detected": """
    SELECT image_id, scope, coalesce(num_gt, 0) AS num_gt, coalesce(num_pred, 0) AS num_pred, coalesce(tp, 0) AS tp, coalesce(num_pred, 0) - coalesce(tp, 0) AS fp, coalesce(num_gt, 0) - coalesce(tp, 0) AS fn, matched_iou_mean, matched_iou_median
    FROM (SELECT image_id, unnest(['full_frame', 'roi']) AS scope FROM images)
    LEFT JOIN (SELECT image_id, scope, count(*) AS num_gt, count(*) FILTER (detected) AS tp, avg(matched_iou) AS matched_iou_mean, median(matched_iou) AS matched_iou_median FROM per_gt GROUP BY ALL) USING (image_id, scope)
    LEFT JOIN (SELECT image_id, scope, count(*) AS num_pred FROM scoped_pred GROUP BY ALL) USING (image_id, scope)""",
        "detection_blocks": """
    SELECT image_id, scope, num_gt, num_pred, tp, fp, fn,
      CASE WHEN num_gt = 0 AND num_pred = 0 THEN 1 WHEN num_gt = 0 THEN 0 WHEN num_pred = 0 THEN NULL ELSE tp::DOUBLE / num_pred END AS precision,
      CASE WHEN num_gt = 0 AND num_pred = 0 THEN 1 WHEN num_gt = 0 THEN NULL WHEN num_pred = 0 THEN 0 ELSE tp::DOUBLE / num_gt END AS recall,
      CASE WHEN num_gt = 0 AND num_pred = 0 THEN 1 WHEN num_gt = 0 OR num_pred = 0 THEN NULL WHEN tp = 0 THEN 0 ELSE 2 * (tp::DOUBLE / num_pred) * (tp::DOUBLE / num_gt) / (tp::DOUBLE / num_pred + tp::DOUBLE / num_gt) END AS f1,
      matched_iou_mean, matched_iou_median, num_gt = 0 AND num_pred = 0 AS is_empty_trivial FROM detected"""}


_BY_CENTROID = _detections("cy >= 32 AND cy < 224 AND cx >= 32 AND cx < 224")
_ANY_PIXEL = _detections("EXISTS (SELECT 1 FROM gt_px x WHERE x.image_id = m.image_id AND x.inst_id = m.inst_id AND x.y >= 32 AND x.y < 224 AND x.x >= 32 AND x.x < 224)")


@query("a8_typed_blocks", """
    SELECT image_id, scope, 'satellites' AS type, num_gt, num_pred, precision, recall, f1 FROM raw_blocks
    UNION ALL SELECT image_id, scope, 'streams', num_gt, num_pred, precision, recall, f1 FROM detection_blocks""", doubles="precision recall f1", ctes={**_CTES, **_BY_CENTROID})
def _(t):
    """Satellite taxonomy blocks and stream detection blocks of both scopes as one long table."""
    from maskwright.plans.report import stream_blocks

    sat = blocks(t, t.candidates).select("image_id", "scope", F.lit("satellites").alias("type"), "num_gt", "num_pred", "precision", "recall", "f1")
    st = stream_blocks(t.pred_of("tidal_features"), t.gt_of("tidal_features"), t.images, ROI)
    return sat.unionByName(st.select("image_id", "scope", F.lit("streams").alias("type"), "num_gt", "num_pred", "precision", "recall", "f1"))


@query("a7_detection_block", "SELECT * FROM detection_blocks", doubles="precision recall f1 matched_iou_mean matched_iou_median", ctes=_BY_CENTROID)
def _(t):
    from maskwright.plans.report import stream_blocks

    return stream_blocks(t.pred_of("tidal_features"), t.gt_of("tidal_features"), t.images, ROI)


@query("a7_detection_block_rle", "SELECT * FROM detection_blocks", doubles="precision recall f1 matched_iou_mean matched_iou_median", ctes=_ANY_PIXEL)
def _(t):
    from maskwright.plans.report import stream_blocks

    return stream_blocks(t.pred_of("tidal_features"), t.gt_of("tidal_features"), t.images, ROI, gt_any_pixel=True)


@query("a9_sample_report")
def _(t):
    from maskwright.plans.report import sample_report

    layers = {"raw": blocks(t, t.candidates), "post_pred_only": blocks(t, post_candidates(t))}
    return sample_report(layers)


@query("a9_invariant", """
    SELECT image_id, layer, num_gt AS full_num_gt, num_gt_roi AS roi_num_gt FROM num_gt, (SELECT unnest(['raw', 'post_pred_only']) AS layer)
    WHERE num_gt <> num_gt_roi""")
def _(t):
    from maskwright.plans.report import gold_invariant

    layers = {"raw": blocks(t, t.candidates), "post_pred_only": blocks(t, post_candidates(t))}
    totals = num_gt(t).where("scope = 'full_frame'").select("image_id", F.col("num_gt").alias("num_gt_satellites"))
    return gold_invariant(layers, totals)


# The report in three ways: fresh, from stored layers, and from a post layer derived again from stored raw masks.

_TRACED_ONE = _POST["post_one"].replace("FROM gated WHERE gate_reason LIKE 'pass%'", "FROM traced WHERE first_drop_stage IS NULL")
_REPORT = {**_CTES, "kept_one": _TRACED_ONE, "kept_candidates": _POST["post_candidates"].replace("post_one", "kept_one"), "kept_blocks": _BLOCK.format(cands="kept_candidates")}
_REPORT_SQL = """
    SELECT b.*, n.num_gt AS num_gt_satellites, coalesce(r.n, 0) AS n_candidates, coalesce(k.n, 0) AS n_post_candidates
    FROM (SELECT *, 'raw' AS layer FROM raw_blocks UNION ALL SELECT *, 'post_pred_only' FROM kept_blocks) b JOIN num_gt n USING (image_id)
    LEFT JOIN (SELECT image_id, count(*) AS n FROM candidates GROUP BY ALL) r USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM kept_candidates GROUP BY ALL) k USING (image_id)"""


def _run(t, name):
    import uuid

    from maskwright.plans.stored import Run
    from maskwright.session import ensure_checkpoint_dir

    return Run(t.spark, f"{ensure_checkpoint_dir(t.spark)}/run-{name}-{uuid.uuid4().hex}")


def _raw_layer(t):
    from maskwright.plans.stored import RAW, stored_masks

    return stored_masks(t.pred, t.pred_runs, RAW)


@query("a9_report_fresh", _REPORT_SQL, doubles="precision recall f1", ctes=_REPORT)
def _(t):
    from maskwright.plans.stored import fresh_report

    return fresh_report(t.pred_m, t.pred_runs, CFG, t.gt_runs, num_gt(t), ROI, SIDE, "tidal_features")


@query("a9_report_stored", _REPORT_SQL, doubles="precision recall f1", ctes=_REPORT)
def _(t):
    from maskwright.plans.stored import POST, report_from_stored, stored_masks

    run = _run(t, "stored")
    run.save(_raw_layer(t), t.images, "raw")
    kept, _ = post.post_pred_only(t.pred_m, t.pred_runs, CFG, SIDE, SIDE, stream_label="tidal_features")
    kept = held(kept)
    left = t.pred.join(kept.select("image_id", "inst_id").distinct(), ["image_id", "inst_id"], "left_semi")
    run.save(stored_masks(left, kept, POST), t.images, POST)
    return report_from_stored(run, t.gt_runs, num_gt(t), ROI, SIDE)[0]


@query("a9_report_post_from_raw", _REPORT_SQL, doubles="precision recall f1", ctes=_REPORT)
def _(t):
    """Raw masks of one run, post layer in another: once under another policy, then again under the one that counts."""
    from dataclasses import replace

    from maskwright.plans.stored import rebuild_post, report_from_stored

    source, dest = _run(t, "source"), _run(t, "derived")
    source.save(_raw_layer(t), t.images, "raw")
    for cfg in (replace(CFG, core=None), CFG):
        rebuild_post(source, dest, cfg, SIDE, "tidal_features")
    return report_from_stored(dest, t.gt_runs, num_gt(t), ROI, SIDE)[0]


@query("a9_stage_traces", """
    SELECT image_id, count(*) AS n_raw_satellites, count(*) FILTER (first_drop_stage IS NULL) AS n_kept_post, count(*) FILTER (first_drop_stage IS NOT NULL) AS n_removed_post, true AS agrees FROM traced GROUP BY ALL""", ctes=RULES)
def _(t):
    from maskwright.plans.stored import rebuild_post, stage_traces

    run = _run(t, "traced")
    run.save(_raw_layer(t), t.images, "raw")
    rebuild_post(run, run, CFG, SIDE, "tidal_features", allow_inplace=True)
    return stage_traces(run, CFG, SIDE)


@query("a10_detection_micro", """
    SELECT scope, tp, fp, fn, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) AS f1,
      precision_mean, recall_mean, f1_mean, precision_samples, recall_samples, f1_samples, samples_total FROM (
      SELECT scope, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(precision) AS precision_mean, avg(recall) AS recall_mean, avg(f1) AS f1_mean,
        count(precision) AS precision_samples, count(recall) AS recall_samples, count(f1) AS f1_samples, count(*) AS samples_total FROM detection_blocks GROUP BY scope)""",
       doubles="precision recall f1 precision_mean recall_mean f1_mean", ctes=_BY_CENTROID)
def _(t):
    from maskwright.plans.report import stream_blocks

    b = stream_blocks(t.pred_of("tidal_features"), t.gt_of("tidal_features"), t.images, ROI)
    return score.detection_micro(b, ["scope"]).join(score.macro(b, ["scope"]), "scope")


_MICRO = """
    SELECT scope, sum(matched_candidates)::BIGINT AS matched_candidates, sum(unmatched_candidates)::BIGINT AS unmatched_candidates, sum(num_pred)::BIGINT AS num_pred,
           sum(unique_gt_covered)::BIGINT AS unique_gt_covered, sum(num_gt)::BIGINT AS num_gt,
           sum(matched_candidates)::DOUBLE / sum(num_pred) AS precision, sum(unique_gt_covered)::DOUBLE / sum(num_gt) AS recall,
           2 * (sum(matched_candidates)::DOUBLE / sum(num_pred)) * (sum(unique_gt_covered)::DOUBLE / sum(num_gt)) / (sum(matched_candidates)::DOUBLE / sum(num_pred) + sum(unique_gt_covered)::DOUBLE / sum(num_gt)) AS f1
    FROM {b} GROUP BY scope"""


@query("a11_taxonomy_micro", _MICRO.format(b="raw_blocks"), doubles="precision recall f1", ctes=_CTES)
def _(t):
    return score.taxonomy_micro(blocks(t, t.candidates), ["scope"])


@query("entry_gated_taxonomy_micro", _MICRO.format(b="post_blocks"), doubles="precision recall f1", ctes=_CTES)
def _(t):
    return score.taxonomy_micro(blocks(t, post_candidates(t)), ["scope"])


@query("a11_taxonomy_macro", """
    SELECT scope, avg(precision) AS precision_mean, avg(recall) AS recall_mean, avg(f1) AS f1_mean, count(precision) AS precision_samples,
           count(recall) AS recall_samples, count(f1) AS f1_samples, count(*) AS samples_total FROM raw_blocks GROUP BY scope""",
    doubles="precision_mean recall_mean f1_mean", ctes=_CTES)
def _(t):
    return score.macro(blocks(t, t.candidates), ["scope"])


@query("a12_aggregate", """
    SELECT 'raw' AS layer, scope, sum(matched_candidates)::DOUBLE / sum(num_pred) AS micro_precision, sum(unique_gt_covered)::DOUBLE / sum(num_gt) AS micro_recall,
           avg(precision) AS precision_mean, avg(recall) AS recall_mean, count(*) AS samples_total FROM raw_blocks GROUP BY scope
    UNION ALL SELECT 'post_pred_only', scope, sum(matched_candidates)::DOUBLE / sum(num_pred), sum(unique_gt_covered)::DOUBLE / sum(num_gt),
           avg(precision), avg(recall), count(*) FROM post_blocks GROUP BY scope""",
    doubles="micro_precision micro_recall precision_mean recall_mean", ctes=_CTES)
def _(t):
    both = blocks(t, t.candidates).withColumn("layer", F.lit("raw")).unionByName(blocks(t, post_candidates(t)).withColumn("layer", F.lit("post_pred_only")))
    return both.groupBy("layer", "scope").agg(
        (F.sum("matched_candidates") / F.sum("num_pred")).alias("micro_precision"), (F.sum("unique_gt_covered") / F.sum("num_gt")).alias("micro_recall"),
        F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"), F.count(F.lit(1)).alias("samples_total"))


@query("a13_diagnostics_summary", """
    SELECT l.taxonomy_label, f.feature, count(v) AS n, min(v) AS v_min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, max(v) AS v_max
    FROM (SELECT unnest(['compact_complete', 'diffuse_core', 'reject_unmatched', 'reject_low_purity']) AS taxonomy_label) l
    CROSS JOIN (SELECT unnest(['purity', 'completeness', 'seed_gt_ratio']) AS feature) f
    LEFT JOIN (SELECT taxonomy_label, 'purity' AS feature, purity AS v FROM candidates UNION ALL SELECT taxonomy_label, 'completeness', completeness FROM candidates
               UNION ALL SELECT taxonomy_label, 'seed_gt_ratio', seed_gt_ratio FROM candidates) c ON c.taxonomy_label = l.taxonomy_label AND c.feature = f.feature
    GROUP BY ALL""", doubles="v_min p25 median p75 v_max")
def _(t):
    return score.diagnostics_features(t.candidates, ("purity", "completeness", "seed_gt_ratio"))


@query("a13_label_counts", """
    SELECT layer, scope, sum(compact_complete)::BIGINT AS compact_complete, sum(diffuse_core)::BIGINT AS diffuse_core, sum(reject_unmatched)::BIGINT AS reject_unmatched, sum(reject_low_purity)::BIGINT AS reject_low_purity
    FROM (SELECT 'raw' AS layer, * FROM raw_blocks UNION ALL SELECT 'post', * FROM post_blocks) GROUP BY ALL""", ctes=_CTES)
def _(t):
    return _label_counts(t)


def _label_counts(t):
    scope = F.explode(F.when(F.col("intersects_roi"), F.array(F.lit("full_frame"), F.lit("roi"))).otherwise(F.array(F.lit("full_frame"))))
    raw = t.candidates.select("taxonomy_label", scope.alias("scope")).withColumn("layer", F.lit("raw"))
    po = post_candidates(t).select("taxonomy_label", scope.alias("scope")).withColumn("layer", F.lit("post"))
    return score.label_counts(raw.unionByName(po), ["layer", "scope"])


@query("a14_matched_rollup", """
    SELECT sum(CASE WHEN layer = 'raw' THEN matched_candidates END)::BIGINT AS matched_raw, sum(CASE WHEN layer = 'raw' THEN unmatched_candidates END)::BIGINT AS unmatched_raw,
           sum(CASE WHEN layer = 'post' THEN matched_candidates END)::BIGINT AS matched_post, sum(CASE WHEN layer = 'post' THEN unmatched_candidates END)::BIGINT AS unmatched_post
    FROM (SELECT 'raw' AS layer, * FROM raw_blocks UNION ALL SELECT 'post', * FROM post_blocks) WHERE scope = 'roi'""", ctes=_CTES)
def _(t):
    return score.matched_rollup(_label_counts(t).where("scope = 'roi'").withColumnRenamed("layer", "stage"))


# -- curves --------------------------------------------------------------------------------

_CURVE = {
    "scored": "SELECT image_id, score, (taxonomy_label IN ('compact_complete', 'diffuse_core'))::BIGINT AS tp FROM candidates",
    "padded": """
    SELECT score, tp, 1 AS n FROM scored
    UNION ALL SELECT -1, m, m FROM (SELECT greatest((SELECT sum(num_gt) FROM num_gt) - (SELECT sum(tp) FROM scored), 0)::BIGINT AS m) WHERE m > 0""",
    "pts": """
    SELECT score AS threshold, tp, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER () AS pos
    FROM (SELECT score, sum(tp)::BIGINT AS tp, sum(n)::BIGINT AS n FROM padded GROUP BY score) WINDOW w AS (ORDER BY score DESC)""",
    "padded_i": """
    SELECT image_id, score, tp, 1 AS n FROM scored
    UNION ALL SELECT image_id, -1, m, m FROM (SELECT g.image_id, greatest(g.num_gt - coalesce(sum(s.tp), 0), 0)::BIGINT AS m FROM num_gt g LEFT JOIN scored s USING (image_id) GROUP BY g.image_id, g.num_gt) WHERE m > 0""",
    "pts_i": """
    SELECT image_id, score AS threshold, tp, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY image_id) AS pos
    FROM (SELECT image_id, score, sum(tp)::BIGINT AS tp, sum(n)::BIGINT AS n FROM padded_i GROUP BY ALL) WINDOW w AS (PARTITION BY image_id ORDER BY score DESC)""",
    "table_": """
    SELECT threshold AS confidence_threshold, ct::DOUBLE / cn AS precision, ct::DOUBLE / pos AS recall,
           CASE WHEN ct = 0 THEN 0 ELSE 2 * (ct::DOUBLE / cn) * (ct::DOUBLE / pos) / (ct::DOUBLE / cn + ct::DOUBLE / pos) END AS f1 FROM pts""",
}


def _scored(t):
    return t.candidates.select("image_id", "score", F.col("taxonomy_label").isin("compact_complete", "diffuse_core").alias("is_tp"))


def _totals(t):
    return num_gt(t).where("scope = 'full_frame'").select("image_id", "num_gt")


def points(t):
    return score.pr_points(_scored(t).drop("image_id"), _totals(t).agg(F.sum("num_gt").alias("num_gt")))


@query("a15_average_precision", """
    SELECT 'micro' AS kind, sum(tp::DOUBLE / pos * (ct::DOUBLE / cn)) AS average_precision, count(DISTINCT pos) AS n FROM pts WHERE pos > 0
    UNION ALL SELECT 'macro', avg(ap), count(*) FROM (SELECT p.image_id, sum(tp::DOUBLE / pos * (ct::DOUBLE / cn)) AS ap FROM pts_i p JOIN num_gt g USING (image_id) WHERE pos > 0 AND g.num_gt > 0 GROUP BY ALL)""",
    doubles="average_precision", ctes=_CURVE)
def _(t):
    micro = score.average_precision(points(t)).select(F.lit("micro").alias("kind"), "average_precision", F.lit(1).cast("long").alias("n"))
    with_gt = _totals(t).where("num_gt > 0")
    per = score.average_precision(score.pr_points(_scored(t), with_gt, ["image_id"]), ["image_id"])
    per = per.join(with_gt, "image_id", "left_semi")
    macro = per.agg(F.lit("macro").alias("kind"), F.avg("average_precision").alias("average_precision"), F.count(F.lit(1)).alias("n"))
    return micro.unionByName(macro)


@query("a16_pr_curve", """
    SELECT threshold, ct::DOUBLE / cn AS precision, ct::DOUBLE / pos AS recall FROM pts UNION ALL SELECT NULL, 1, 0""",
    doubles="precision recall", ctes=_CURVE)
def _(t):
    return score.pr_curve(points(t))


@query("a17_threshold_table", "SELECT * FROM table_", doubles="precision recall f1", ctes=_CURVE)
def _(t):
    return score.threshold_table(points(t))


@query("a17_threshold_picks", """
    SELECT 'grid_' || printf('%.2f', g.g) AS pick, confidence_threshold, precision, recall, f1
    FROM (SELECT unnest([0.18, 0.30, 0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]::DOUBLE[]) AS g) g
    LEFT JOIN table_ t ON t.confidence_threshold = (SELECT min(u.confidence_threshold) FROM table_ u WHERE u.confidence_threshold >= g.g)
    UNION ALL (SELECT 'best_f1', * FROM table_ ORDER BY f1 DESC, confidence_threshold LIMIT 1)
    UNION ALL (SELECT 'feasible_lowest', t.* FROM (SELECT 1) LEFT JOIN (SELECT * FROM table_ WHERE precision >= 0.6::DOUBLE AND recall >= 0.6::DOUBLE ORDER BY confidence_threshold LIMIT 1) t ON true)
    UNION ALL (SELECT 'feasible_highest', t.* FROM (SELECT 1) LEFT JOIN (SELECT * FROM table_ WHERE precision >= 0.6::DOUBLE AND recall >= 0.6::DOUBLE ORDER BY confidence_threshold DESC LIMIT 1) t ON true)
    UNION ALL (SELECT 'feasible_best_f1', t.* FROM (SELECT 1) LEFT JOIN (SELECT * FROM table_ WHERE precision >= 0.6::DOUBLE AND recall >= 0.6::DOUBLE ORDER BY f1 DESC, confidence_threshold LIMIT 1) t ON true)
    UNION ALL (SELECT 'fallback_best_precision', t.* FROM (SELECT 1) LEFT JOIN (SELECT * FROM table_ WHERE NOT EXISTS (SELECT 1 FROM table_ WHERE precision >= 0.6::DOUBLE AND recall >= 0.6::DOUBLE) ORDER BY precision DESC, recall DESC, confidence_threshold LIMIT 1) t ON true)
    UNION ALL (SELECT 'fallback_best_recall', t.* FROM (SELECT 1) LEFT JOIN (SELECT * FROM table_ WHERE NOT EXISTS (SELECT 1 FROM table_ WHERE precision >= 0.6::DOUBLE AND recall >= 0.6::DOUBLE) ORDER BY recall DESC, precision DESC, confidence_threshold LIMIT 1) t ON true)""",
    doubles="precision recall f1", ctes=_CURVE)
def _(t):
    return score.threshold_picks(score.threshold_table(points(t)), 0.6, 0.6)


_SWEEP = {
    **RULES,
    "taus": "SELECT unnest([0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]::DOUBLE[]) AS tau",
    "sw": """
    SELECT tau, o.* EXCLUDE (is_one_to_one), matched_gt_id IS NOT NULL AND row_number() OVER (PARTITION BY tau, image_id, matched_gt_id ORDER BY overlap_px DESC, inst_id) = 1 AS is_one_to_one
    FROM taus JOIN one2one o ON o.score >= tau JOIN (SELECT image_id, inst_id FROM traced WHERE p_ok AND c_ok) k USING (image_id, inst_id)""",
    "sw_l": """
    SELECT *, NOT (matched_gt_id IS NULL) AND ((completeness >= 0.95::DOUBLE AND is_one_to_one AND seed_gt_ratio <= 3) OR purity >= 0.5::DOUBLE) AS ok FROM sw""",
    "gt_any": "SELECT count(DISTINCT (image_id, inst_id)) AS n FROM gt_px WHERE type_label = 'satellites' AND y >= 32 AND y < 224 AND x >= 32 AND x < 224",
    "sweep": """
    SELECT t.tau AS threshold, t.scope, ok_n::DOUBLE / nullif(n, 0) AS precision, cov::DOUBLE / nullif(g, 0) AS recall,
           CASE WHEN ok_n + cov = 0 AND n > 0 THEN 0 ELSE 2 * (ok_n::DOUBLE / nullif(n, 0)) * (cov::DOUBLE / g) / (ok_n::DOUBLE / nullif(n, 0) + cov::DOUBLE / g) END AS f1,
           ok_n AS matched, n - ok_n AS unmatched, cov AS unique_gt_covered, g AS num_gt, n AS num_pred
    FROM (SELECT taus.tau, s.scope, count(w.inst_id) AS n, count(w.inst_id) FILTER (ok) AS ok_n, count(DISTINCT (w.image_id, w.matched_gt_id)) FILTER (ok) AS cov,
            CASE WHEN s.scope = 'roi' THEN (SELECT n FROM gt_any) ELSE (SELECT sum(num_gt)::BIGINT FROM num_gt) END AS g
          FROM taus CROSS JOIN (SELECT unnest(['full_frame', 'roi']) AS scope) s
          LEFT JOIN sw_l w ON w.tau = taus.tau AND (s.scope = 'full_frame' OR w.intersects_roi) GROUP BY taus.tau, s.scope) t""",
}


def _sweep(t):
    primary = match.primary_match(t.sat_hits, t.sats.withColumn("raw_index", F.col("inst_id")))
    gt = R.window_fraction(t.gt_of("satellites"), ROI).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("num_gt"), F.count_if(F.col("inside_px") > 0).alias("num_gt_roi"))
    cfg = post.PostConfig(sanity=None, gate=GATE, prior=PRIOR, core=CORE, conflict=None)
    return post.policy_sweep(primary, gt, cfg, Taxonomy(), SIDE, ROI)


@query("a18_policy_sweep", "SELECT * FROM sweep", doubles="precision recall f1", ctes=_SWEEP)
def _(t):
    return _sweep(t)


@query("a18_sweep_picks", """
    SELECT scope, auc_pr, b.threshold AS best_threshold, b.precision AS best_precision, b.recall AS best_recall, b.f1 AS best_f1, n_feasible, feasible_lowest, feasible_highest
    FROM (SELECT scope, sum((recall - pr) * precision) AS auc_pr FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY scope ORDER BY recall, threshold), 0) AS pr FROM sweep WHERE precision IS NOT NULL) GROUP BY ALL)
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY f1 DESC, threshold) AS rn FROM sweep WHERE f1 IS NOT NULL) WHERE rn = 1) b USING (scope)
    JOIN (SELECT scope, count(*) FILTER (ok) AS n_feasible, min(threshold) FILTER (ok) AS feasible_lowest, max(threshold) FILTER (ok) AS feasible_highest
          FROM (SELECT *, precision >= 0.3::DOUBLE AND recall >= 0.3::DOUBLE AS ok FROM sweep) GROUP BY ALL) USING (scope)""",
    doubles="auc_pr best_precision best_recall best_f1", ctes=_SWEEP)
def _(t):
    return post.sweep_picks(_sweep(t), 0.3)


# -- raw against post ------------------------------------------------------------------------

_TRADE = {
    **_CTES,
    "trade": """
    SELECT r.image_id, r.num_gt AS num_gt_satellites_roi, r.num_pred AS num_pred_raw_roi, p.num_pred AS num_pred_post_roi,
           r.compact_complete AS compact_complete_raw, r.diffuse_core AS diffuse_core_raw, r.reject_unmatched AS reject_unmatched_raw, r.reject_low_purity AS reject_low_purity_raw,
           p.compact_complete AS compact_complete_post, p.diffuse_core AS diffuse_core_post, p.reject_unmatched AS reject_unmatched_post, p.reject_low_purity AS reject_low_purity_post,
           r.matched_candidates AS matched_candidates_raw, r.unmatched_candidates AS unmatched_candidates_raw, p.matched_candidates AS matched_candidates_post, p.unmatched_candidates AS unmatched_candidates_post,
           r.unique_gt_covered AS unique_gt_covered_raw, p.unique_gt_covered AS unique_gt_covered_post,
           (r.unique_gt_covered - p.unique_gt_covered)::DOUBLE AS unique_gt_lost_post, (r.matched_candidates - p.matched_candidates)::DOUBLE AS matched_candidates_removed,
           (r.unmatched_candidates - p.unmatched_candidates)::DOUBLE AS unmatched_candidates_removed,
           p.unique_gt_covered::DOUBLE / nullif(r.unique_gt_covered, 0) AS gt_coverage_retention, (r.unique_gt_covered - p.unique_gt_covered)::DOUBLE / nullif(r.unique_gt_covered, 0) AS gt_coverage_loss_rate,
           p.matched_candidates::DOUBLE / nullif(r.matched_candidates, 0) AS matched_candidate_retention, (r.matched_candidates - p.matched_candidates)::DOUBLE / nullif(r.matched_candidates, 0) AS matched_candidate_loss_rate,
           (r.unmatched_candidates - p.unmatched_candidates)::DOUBLE / nullif(r.unmatched_candidates, 0) AS unmatched_candidate_removal_rate,
           p.unmatched_candidates::DOUBLE / nullif(p.num_pred, 0) AS residual_unmatched_candidate_fraction,
           r.matched_candidates::DOUBLE / nullif(r.num_pred, 0) AS tax_precision_raw, r.unique_gt_covered::DOUBLE / nullif(r.num_gt, 0) AS tax_recall_raw,
           p.matched_candidates::DOUBLE / nullif(p.num_pred, 0) AS tax_precision_post, p.unique_gt_covered::DOUBLE / nullif(p.num_gt, 0) AS tax_recall_post,
           p.matched_candidates::DOUBLE / nullif(p.num_pred, 0) - r.matched_candidates::DOUBLE / nullif(r.num_pred, 0) AS delta_tax_precision,
           p.unique_gt_covered::DOUBLE / nullif(p.num_gt, 0) - r.unique_gt_covered::DOUBLE / nullif(r.num_gt, 0) AS delta_tax_recall,
           concat_ws(',', CASE WHEN r.matched_candidates < p.matched_candidates THEN 'matched_candidates_removed_negative' END,
                     CASE WHEN r.unmatched_candidates < p.unmatched_candidates THEN 'unmatched_candidates_removed_negative' END,
                     CASE WHEN r.unique_gt_covered < p.unique_gt_covered THEN 'unique_gt_lost_post_negative' END) AS warnings
    FROM raw_blocks r JOIN post_blocks p USING (image_id, scope) WHERE scope = 'roi'""",
}
_RATES = " ".join(("gt_coverage_retention", "gt_coverage_loss_rate", "matched_candidate_retention", "matched_candidate_loss_rate", "unmatched_candidate_removal_rate",
                   "residual_unmatched_candidate_fraction", "tax_precision_raw", "tax_recall_raw", "tax_precision_post", "tax_recall_post", "delta_tax_precision", "delta_tax_recall"))


def trade(t):
    raw = blocks(t, t.candidates).where("scope = 'roi'")
    return tradeoff.tradeoff_rows(raw, blocks(t, post_candidates(t)).where("scope = 'roi'"))


@query("a19_tradeoff_rows", "SELECT * FROM trade", doubles=_RATES, ctes=_TRADE)
def _(t):
    return trade(t)


@query("a20_paired_scores", """
    SELECT metric, count(*) FILTER (kind = 'natural') AS "natural", count(*) FILTER (kind = 'vacuous') AS vacuous, count(*) FILTER (kind = 'excluded') AS excluded,
           count(*) FILTER (kind <> 'excluded') AS paired, count(*) AS total, avg(r) FILTER (kind <> 'excluded') AS mean_raw, avg(p) FILTER (kind <> 'excluded') AS mean_post,
           avg(p) FILTER (kind <> 'excluded') - avg(r) FILTER (kind <> 'excluded') AS delta_mean
    FROM (SELECT 'precision' AS metric, coalesce(tax_precision_raw, 1) AS r, coalesce(tax_precision_post, 1) AS p,
            CASE WHEN (num_pred_raw_roi = 0 OR num_pred_post_roi = 0) AND num_gt_satellites_roi > 0 THEN 'excluded' WHEN num_pred_raw_roi = 0 OR num_pred_post_roi = 0 THEN 'vacuous' ELSE 'natural' END AS kind FROM trade
          UNION ALL SELECT 'recall', coalesce(tax_recall_raw, 1), coalesce(tax_recall_post, 1),
            CASE WHEN num_gt_satellites_roi = 0 AND (num_pred_raw_roi > 0 OR num_pred_post_roi > 0) THEN 'excluded' WHEN num_gt_satellites_roi = 0 THEN 'vacuous' ELSE 'natural' END FROM trade) GROUP BY ALL""",
    doubles="mean_raw mean_post delta_mean", ctes=_TRADE)
def _(t):
    return tradeoff.paired_scores(trade(t))


@query("a21_tradeoff_summary", """
    SELECT count(*) AS n_samples, """ + ", ".join(f"sum({c})::BIGINT AS {c}" for c in tradeoff.TOTALS) + """, sum(num_gt_satellites_roi)::BIGINT AS num_gt,
           sum(matched_candidates_raw)::DOUBLE / sum(num_pred_raw_roi) AS micro_precision_raw, sum(unique_gt_covered_raw)::DOUBLE / sum(num_gt_satellites_roi) AS micro_recall_raw,
           sum(matched_candidates_post)::DOUBLE / sum(num_pred_post_roi) AS micro_precision_post, sum(unique_gt_covered_post)::DOUBLE / sum(num_gt_satellites_roi) AS micro_recall_post FROM trade""",
    doubles="micro_precision_raw micro_recall_raw micro_precision_post micro_recall_post", ctes=_TRADE)
def _(t):
    return tradeoff.tradeoff_summary(trade(t))


@query("a22_rate_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS valid, count(*) - count({c}) AS omitted, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max FROM trade"
    for c in tradeoff.RATES), doubles="mean median std min max", ctes=_TRADE)
def _(t):
    return tradeoff.numeric_stats(trade(t), tradeoff.RATES)


@query("a23_count_by_key", """
    SELECT coalesce(matched_gt_id IS NULL, true)::VARCHAR AS key, count(*) AS n FROM candidates GROUP BY ALL
    UNION ALL SELECT 'null', count(*) FROM candidates WHERE matched_gt_id IS NULL HAVING count(*) > 0""")
def _(t):
    none = F.when(F.col("matched_gt_id").isNull(), F.lit(None).cast("string"))
    flags = t.candidates.select(F.col("matched_gt_id").isNull().alias("k"))
    nulls = t.candidates.where("matched_gt_id is null").select(none.alias("k"))
    return tradeoff.count_by_key(flags, "k").unionByName(tradeoff.count_by_key(nulls, "k"))


def _identified(t):
    """Candidates with identity; every fifth post row lost its hash, every ninth its identity too."""
    sha = F.substring(F.sha1(F.concat_ws(":", "image_id", "raw_index").cast("binary")), 1, 16)
    cand = t.candidates.withColumn("candidate_id", F.concat(F.lit("sat_"), F.col("raw_index").cast("string"))).withColumn("candidate_rle_sha1", sha)
    po = gated(t).select("image_id", "raw_index", F.concat(F.lit("sat_"), F.col("raw_index").cast("string")).alias("candidate_id"))
    po = po.withColumn("candidate_rle_sha1", F.when(F.col("raw_index") % 5 != 0, sha))
    po = po.withColumn("candidate_id", F.when(F.col("raw_index") % 45 == 0, "lost").otherwise(F.col("candidate_id")))
    raw = cand.select("image_id", "raw_index", "candidate_id", "candidate_rle_sha1")
    return cand, raw, po, tradeoff.link_post_to_raw(cand, raw, po)


_LINKS = {**RULES, "links": """
    SELECT image_id, inst_id, CASE WHEN inst_id % 5 <> 0 THEN 'sha' WHEN inst_id % 45 = 0 THEN 'missing' ELSE 'identity' END AS link
    FROM gated WHERE gate_reason LIKE 'pass%'""",
    "disp": """SELECT c.*, l.inst_id IS NOT NULL AS kept FROM candidates c LEFT JOIN (SELECT * FROM links WHERE link <> 'missing') l USING (image_id, inst_id) WHERE intersects_roi"""}


@query("e13_link_counts", """
    SELECT image_id, count(*) FILTER (link = 'missing') AS missing_post_links, count(*) FILTER (link = 'sha') AS used_sha_links, count(*) FILTER (link = 'identity') AS used_identity_links
    FROM links GROUP BY ALL""", ctes=_LINKS)
def _(t):
    return tradeoff.link_counts(_identified(t)[3])


@query("e14_coverage", """
    SELECT image_id, count(*) AS raw_candidates_roi, count(*) FILTER (m) AS matched_candidates_raw, count(DISTINCT matched_gt_id) FILTER (m) AS unique_gt_covered_raw,
           count(*) FILTER (kept) AS post_candidates_roi, count(*) FILTER (m AND kept) AS matched_candidates_post, count(DISTINCT matched_gt_id) FILTER (m AND kept) AS unique_gt_covered_post
    FROM (SELECT *, taxonomy_label IN ('compact_complete', 'diffuse_core') AS m FROM disp) GROUP BY image_id""", ctes=_LINKS)
def _(t):
    cand, _, _, links = _identified(t)
    return tradeoff.coverage_from_links(cand, links, F.col("intersects_roi"))


@query("a19_tradeoff_rows_legacy")
def _(t):
    cand, _, _, links = _identified(t)
    cov = tradeoff.coverage_from_links(cand, links, F.col("intersects_roi"))
    return tradeoff.tradeoff_rows_from_links(cov, links, num_gt(t).where("scope = 'roi'"))


def _disp(t, matched=True):
    cand, _, _, links = _identified(t)
    return tradeoff.dispositions(cand, links, F.col("intersects_roi"), matched)


for _kind, _labels in (("matched", "('compact_complete', 'diffuse_core')"), ("unmatched", "('reject_unmatched', 'reject_low_purity')")):
    def _make(kind):
        @query(f"a24_dispositions_{kind}", f"""
            SELECT g AS grouping, k AS key, count(*) AS raw_total, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed, (count(*) FILTER (NOT kept))::DOUBLE / count(*) AS removal_rate
            FROM (SELECT 'taxonomy_label' AS g, taxonomy_label AS k, * FROM disp UNION ALL SELECT 'label_reason', label_reason, * FROM disp)
            WHERE taxonomy_label IN {_labels} GROUP BY ALL""", doubles="removal_rate", ctes=_LINKS)
        def _(t):
            return tradeoff.disposition_groups(_disp(t, kind == "matched"))

        @query(f"a24_status_stats_{kind}", " UNION ALL ".join(f"""
            SELECT CASE WHEN kept THEN 'kept' ELSE 'removed' END AS post_status, '{c}' AS field, count({c}) AS valid, count(*) - count({c}) AS omitted, avg({c}) AS mean,
                   quantile_cont({c}::DOUBLE, 0.5) AS median, stddev_pop({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM disp WHERE taxonomy_label IN {_labels} GROUP BY ALL"""
            for c in ("purity", "completeness", "seed_gt_ratio", "score")), doubles="mean median std min max", ctes=_LINKS)
        def _(t):
            return tradeoff.numeric_stats(_disp(t, kind == "matched"), ("purity", "completeness", "seed_gt_ratio", "score"), ["post_status"])

    _make(_kind)

_GONE = {**_LINKS, "gone": "SELECT * FROM disp WHERE NOT kept AND taxonomy_label IN ('compact_complete', 'diffuse_core')"}


@query("a25_removed_matched", """
    SELECT g AS grouping, k AS key, count(*) AS removed, count(*)::DOUBLE / (SELECT count(*) FROM gone) AS fraction, count(DISTINCT matched_gt_id) AS unique_matched_gt_ids,
           count(*) FILTER (is_one_to_one) AS one_to_one
    FROM (SELECT 'all' AS g, 'all' AS k, * FROM gone UNION ALL SELECT 'taxonomy_label', taxonomy_label, * FROM gone UNION ALL SELECT 'label_reason', label_reason, * FROM gone) GROUP BY ALL""",
    doubles="fraction", ctes=_GONE)
def _(t):
    return tradeoff.removed_matched(_disp(t))


@query("a25_removed_per_sample", """
    SELECT image_id, count(*) AS n_removed_matched_candidates, count(DISTINCT matched_gt_id) AS unique_removed_matched_gt_ids FROM gone GROUP BY ALL""", ctes=_GONE)
def _(t):
    return tradeoff.removed_per_sample(_disp(t))


def _traced(t, matched=True):
    cand, _, _, links = _identified(t)
    tr = trace(t).select("image_id", F.col("inst_id").alias("raw_index"), F.concat(F.lit("sat_"), F.col("inst_id").cast("string")).alias("candidate_id"),
                         "first_drop_stage", "first_drop_reason", "stage_results").withColumn("candidate_rle_sha1", F.lit(None).cast("string"))
    rows = tradeoff.dispositions(cand, links, F.col("intersects_roi"), matched)
    return tradeoff.join_stage_trace(rows, tr, ("score_gate", "prior_filter", "core_policy"))


_STAGED = {**_LINKS, "staged": """
    SELECT d.*, t.g_ok, t.p_ok, t.c_ok, t.first_drop_stage, t.first_drop_reason FROM disp d JOIN (SELECT image_id, inst_id, g_ok, p_ok, c_ok, first_drop_stage, first_drop_reason FROM traced) t USING (image_id, inst_id)"""}


@query("e15_stage_trace", """
    SELECT image_id, inst_id AS raw_index, first_drop_stage, first_drop_reason, CASE WHEN g_ok THEN 'pass' ELSE 'drop' END AS score_gate_outcome,
           CASE WHEN NOT g_ok THEN 'not_reached' WHEN p_ok THEN 'pass' ELSE 'drop' END AS prior_filter_outcome FROM staged WHERE taxonomy_label IN ('compact_complete', 'diffuse_core')""", ctes=_STAGED)
def _(t):
    return _traced(t).select("image_id", "raw_index", "first_drop_stage", "first_drop_reason", "score_gate_outcome", "prior_filter_outcome")


for _kind, _labels in (("matched", "('compact_complete', 'diffuse_core')"), ("unmatched", "('reject_unmatched', 'reject_low_purity')")):
    def _make2(kind):
        @query(f"a26_stage_attribution_{kind}", f"""
            SELECT g AS grouping, k AS key, stage, count(*) FILTER (e) AS entered, count(*) FILTER (d) AS dropped, count(*) FILTER (e) - count(*) FILTER (d) AS survived_stage,
                   (count(*) FILTER (d))::DOUBLE / nullif(count(*) FILTER (e), 0) AS conditional_drop_rate
            FROM (SELECT *, unnest(['all', 'taxonomy_label', 'label_reason']) AS g, unnest(['all', taxonomy_label, label_reason]) AS k FROM (
              SELECT taxonomy_label, label_reason, 'score_gate' AS stage, true AS e, NOT g_ok AS d FROM staged
              UNION ALL SELECT taxonomy_label, label_reason, 'prior_filter', g_ok, g_ok AND NOT p_ok FROM staged
              UNION ALL SELECT taxonomy_label, label_reason, 'core_policy', g_ok AND p_ok, g_ok AND p_ok AND NOT c_ok FROM staged)
              WHERE taxonomy_label IN {_labels}) GROUP BY ALL""", doubles="conditional_drop_rate", ctes=_STAGED)
        def _(t):
            return tradeoff.stage_attribution(_traced(t, kind == "matched"), ("score_gate", "prior_filter", "core_policy"))

    _make2(_kind)


# -- shape statistics ---------------------------------------------------------------------------

_STATS = {"stats": """
    SELECT type_label AS feature_type, (27 + image_id % 3)::DOUBLE AS sb_threshold, count(*)::DOUBLE AS area, (max(x) - min(x) + 1)::DOUBLE AS bbox_w,
           (max(y) - min(y) + 1)::DOUBLE AS bbox_h, round(count(*)::DOUBLE / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 9) AS extent FROM gt_px GROUP BY image_id, inst_id, type_label"""}


def stats(t):
    per = shape.perimeter(t.gt_runs).withColumn("extent", F.round("extent", 9))
    return t.gt.select("image_id", "inst_id", F.col("type_label").alias("feature_type")).join(per, ["image_id", "inst_id"]).withColumn(
        "sb_threshold", (27 + F.col("image_id") % 3).cast("double"))


_METRICS = ("area", "bbox_w", "bbox_h", "extent")


@query("a27_mask_stats_summary", " UNION ALL ".join(f"""
    SELECT feature_type, s AS sb_threshold, '{m}' AS metric, count(*) AS n, """ + ", ".join(
        f"round(quantile_cont({m}, {q}), 4) AS p{int(round(q * 100)):02d}" for q in tradeoff.QUANTILES) + """
    FROM (SELECT *, unnest([sb_threshold, NULL]) AS s FROM stats) GROUP BY feature_type, s""" for m in _METRICS), ctes=_STATS)
def _(t):
    return tradeoff.mask_stats_summary(stats(t), _METRICS)


@query("a28_filter_recommendations", """
    SELECT feature_type, round(quantile_cont(area, 0.01), 4) AS min_area, round(quantile_cont(area, 0.99), 4) AS max_area, NULL::DOUBLE AS min_solidity, 999.0::DOUBLE AS aspect_sym_moment_max,
           999.0::DOUBLE AS aspect_sym_boundary_max, 999.0::DOUBLE AS curvature_ratio_p99, count(*) AS n_instances FROM stats GROUP BY ALL""", ctes=_STATS)
def _(t):
    return tradeoff.filter_recommendations(tradeoff.mask_stats_summary(stats(t), _METRICS))


@query("a29_metric_trends", """
    SELECT feature_type, sb_threshold, quantile_cont(area, 0.5) AS area, quantile_cont(extent, 0.5) AS extent FROM stats GROUP BY ALL""", doubles="extent", ctes=_STATS)
def _(t):
    return tradeoff.metric_trends(stats(t), ("area", "extent"))


@query("w7_count_quantiles", """
    SELECT type_label, min(area)::DOUBLE AS v_min, quantile_cont(area::DOUBLE, 0.25) AS p25, quantile_cont(area::DOUBLE, 0.5) AS median, quantile_cont(area::DOUBLE, 0.75) AS p75, max(area)::DOUBLE AS v_max
    FROM gt_m GROUP BY ALL""")
def _(t):
    ends = t.gt_m.groupBy("type_label").agg(
        F.min("area").cast("double").alias("v_min"), F.max("area").cast("double").alias("v_max"))
    return with_quantiles(ends, t.gt_m, ["type_label"], "area", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@query("a36_pixel_summary", """
    SELECT type_label, count(*) AS n_images, avg(dice) AS dice_mean, avg(pp) AS pixel_precision_mean, avg(pr) AS pixel_recall_mean, stddev_pop(dice) AS dice_std, stddev_pop(pp) AS pixel_precision_std,
           stddev_pop(pr) AS pixel_recall_std, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS micro_dice,
           sum(tp)::DOUBLE / sum(tp + fp) AS micro_precision, sum(tp)::DOUBLE / sum(tp + fn) AS micro_recall, count(*) FILTER (tp + fp = 0) AS n_empty_pred, count(*) FILTER (tp + fn = 0) AS n_empty_gt
    FROM (SELECT *, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS dice, tp::DOUBLE / nullif(tp + fp, 0) AS pp, tp::DOUBLE / nullif(tp + fn, 0) AS pr FROM typed) GROUP BY type_label""",
    doubles="dice_mean pixel_precision_mean pixel_recall_mean dice_std pixel_precision_std pixel_recall_std micro_dice micro_precision micro_recall",
    ctes={"typed": """SELECT i.image_id, i.type_label, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn
          FROM (SELECT image_id, unnest(['satellites', 'tidal_features']) AS type_label FROM images) i
          LEFT JOIN (SELECT image_id, type_label, count(DISTINCT (y, x)) AS np FROM pred_px GROUP BY ALL) USING (image_id, type_label)
          LEFT JOIN (SELECT image_id, type_label, count(DISTINCT (y, x)) AS ng FROM gt_px GROUP BY ALL) USING (image_id, type_label)
          LEFT JOIN (SELECT image_id, type_label, count(*) AS tp FROM (SELECT DISTINCT image_id, type_label, y, x FROM pred_px) JOIN (SELECT DISTINCT image_id, type_label, y, x FROM gt_px) USING (image_id, type_label, y, x) GROUP BY ALL) USING (image_id, type_label)"""})
def _(t):
    units = t.images.withColumn("type_label", F.explode(F.array(F.lit("satellites"), F.lit("tidal_features"))))
    counts = score.pixel_counts(t.pred_runs, t.gt_runs, units, ("image_id", "type_label"))
    return score.pixel_summary(score.pixel_scores(counts), ["type_label"])
