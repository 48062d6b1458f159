"""Named queries: policies, decision histories and post-processing layers."""

from pyspark.sql import functions as F

from maskwright.catalog import query
from maskwright.catalog.matching import CONFLICT, _CONFLICT, conflicts
from maskwright.functions import policies as P
from maskwright.operators import runs as R, shape
from maskwright.plans import history, post
from maskwright.plans.fixtures import ROI, SIDE

GATE = P.ScoreGate(80, 160, 0.6, 0.4, 0.3)
PRIOR = P.PriorFilter(60, 0.75, 2.0, 0.06)
RELABEL = P.PriorFilter(60, 0.75, 2.0, 0.06, "relabel_inner_galaxy")
CORE = P.CorePolicy(0.10, 0.20, 100, 0.80, 1.90, 0.30)

# The rules with the thresholds above, spelled out again in SQL.
RULES = {
    "gated": """
    SELECT *, CASE WHEN area < 80 THEN CASE WHEN score >= 0.6::DOUBLE THEN 'pass_small' ELSE 'drop_small_score' END
                   WHEN area < 160 THEN CASE WHEN score >= 0.4::DOUBLE THEN 'pass_medium' ELSE 'drop_medium_score' END
                   ELSE CASE WHEN score >= 0.3::DOUBLE THEN 'pass_large' ELSE 'drop_large_score' END END AS gate_reason,
           CASE WHEN dist_to_center / 256 < 0.06::DOUBLE THEN 'prior_hard_center' WHEN area < 60 THEN 'prior_area_low'
                WHEN solidity < 0.75::DOUBLE THEN 'prior_solidity' WHEN aspect_sym_moment > 2.0::DOUBLE THEN 'prior_aspect'
                ELSE 'pass_prior_filter' END AS prior_reason,
           CASE WHEN dist_to_center / 256 < 0.10::DOUBLE THEN 'drop_hard_core'
                WHEN dist_to_center / 256 < 0.20::DOUBLE THEN
                  CASE WHEN area >= 100 AND score >= 0.30::DOUBLE AND solidity >= 0.80::DOUBLE AND aspect_sym_moment <= 1.90::DOUBLE
                       THEN 'rescue_soft_core' ELSE 'drop_soft_core' END
                ELSE 'pass_outside_core' END AS core_reason
    FROM pred_m WHERE type_label = 'satellites'""",
    "traced": """
    SELECT *, gate_reason LIKE 'pass%' AS g_ok, prior_reason LIKE 'pass%' AS p_ok, core_reason NOT LIKE 'drop%' AS c_ok,
           CASE WHEN gate_reason LIKE 'drop%' THEN 'score_gate' WHEN prior_reason NOT LIKE 'pass%' THEN 'prior_filter'
                WHEN core_reason LIKE 'drop%' THEN 'core_policy' END AS first_drop_stage,
           CASE WHEN gate_reason LIKE 'drop%' THEN gate_reason WHEN prior_reason NOT LIKE 'pass%' THEN prior_reason
                WHEN core_reason LIKE 'drop%' THEN core_reason END AS first_drop_reason
    FROM gated""",
    "hist": """
    SELECT t.image_id, t.inst_id, t.gate_reason, t.prior_reason, t.core_reason, c.reason AS conf_reason, c.matched_stream_id,
           CASE WHEN NOT g_ok THEN 'dropped' WHEN prior_reason = 'prior_hard_center' THEN 'relabeled_inner_galaxy'
                WHEN NOT p_ok THEN 'dropped' WHEN NOT c_ok THEN 'dropped' WHEN c.decision = 'drop' THEN 'dropped' ELSE 'kept' END AS final_status,
           CASE WHEN NOT g_ok THEN 'size_aware_score_gate' WHEN prior_reason = 'prior_hard_center' THEN NULL
                WHEN NOT p_ok THEN 'satellite_prior_filter' WHEN NOT c_ok THEN 'core_exclusion_or_soft_core_rescue'
                WHEN c.decision = 'drop' THEN 'stream_conflict_resolution' END AS drop_stage
    FROM traced t JOIN conflict c ON c.image_id = t.image_id AND c.pred_id = t.inst_id""",
}
ALL = {**_CONFLICT, **RULES}
_ID = ["image_id", "inst_id"]


@query("p1_prompt_threshold", """
    SELECT image_id, inst_id, type_label, score FROM pred
    WHERE score >= CASE type_label WHEN 'satellites' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END""")
def _(t):
    from maskwright.operators.dataset import apply_prompt_thresholds

    limits = t.spark.createDataFrame([("satellites", 0.4), ("tidal_features", 0.6)], "type_label string, min_score double")
    return apply_prompt_thresholds(t.pred, limits).select("image_id", "inst_id", "type_label", "score")


@query("p2_normalize_label", """
    SELECT inst_id % 7 AS k, CASE inst_id % 7 WHEN 0 THEN 'tidal_features' WHEN 1 THEN 'tidal_features' WHEN 2 THEN 'tidal_features'
           WHEN 3 THEN 'satellites' WHEN 4 THEN 'satellites' WHEN 5 THEN 'inner_galaxy' ELSE 'satellites' END AS label, count(*) AS n
    FROM boxes GROUP BY ALL""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("streams", "stellar stream", "stellar streams", "satellite galaxy",
                                         "satellite galaxies", "inner_galaxy", "satellites")])
    raw = t.boxes.select(F.expr("inst_id % 7").alias("k")).withColumn("raw", names[F.col("k").cast("int")])
    return raw.select("k", P.normalize_type_label(F.col("raw")).alias("label")).groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))


@query("p3_score_gate", """
    SELECT image_id, inst_id, split_part(gate_reason, '_', 1) AS decision, gate_reason AS reason FROM gated""", ctes=RULES)
def _(t):
    v = GATE.decide(F.col("area"), F.col("score"))
    return t.sats.select(*_ID, v.alias("v")).select(*_ID, "v.decision", "v.reason")


@query("p4_prior_filter", """
    SELECT image_id, inst_id, CASE WHEN prior_reason LIKE 'pass%' THEN 'pass' WHEN prior_reason = 'prior_hard_center' THEN 'relabel' ELSE 'drop' END AS decision,
           prior_reason AS reason, CASE WHEN prior_reason = 'prior_hard_center' THEN 'inner_galaxy' END AS target FROM gated""", ctes=RULES)
def _(t):
    v = RELABEL.decide(F.col("area"), F.col("solidity"), F.col("aspect_sym_moment"), F.col("dist_to_center"), SIDE)
    return t.sats.select(*_ID, v.alias("v")).select(*_ID, "v.*")


@query("p5_core_policy", """
    SELECT image_id, inst_id, split_part(core_reason, '_', 1) AS decision, core_reason AS reason FROM gated""", ctes=RULES)
def _(t):
    v = CORE.decide(F.col("dist_to_center"), F.col("area"), F.col("score"), F.col("solidity"), F.col("aspect_sym_moment"), SIDE)
    return t.sats.select(*_ID, v.alias("v")).select(*_ID, "v.*")


@query("p6_core_exclusion", """
    SELECT image_id, count(*) AS n_masks, count(*) FILTER (hit) AS n_core, quantile_cont(dist_to_center, 0.05) AS dist_p05,
           quantile_cont(dist_to_center, 0.5) AS dist_p50, quantile_cont(dist_to_center, 0.95) AS dist_p95,
           min(area) FILTER (hit) AS core_area_min, max(area) FILTER (hit) AS core_area_max, avg(area) FILTER (hit) AS core_area_mean,
           avg(solidity) FILTER (hit) AS core_solidity_mean
    FROM (SELECT *, dist_to_center < 0.2::DOUBLE * 256 AS hit FROM pred_m) GROUP BY ALL""",
    doubles="dist_p05 dist_p50 dist_p95 core_area_mean core_solidity_mean")
def _(t):
    from maskwright.operators.dataset import core_exclusion

    return core_exclusion(t.pred_m, SIDE, 0.2)[1]


@query("p7_streams_sanity", """
    SELECT p.image_id, p.inst_id, CASE WHEN area < 80 THEN 'sanity_area_low' WHEN area > 200 THEN 'sanity_area_high'
           WHEN b::DOUBLE / area > 0.05::DOUBLE THEN 'sanity_edge' END AS reject_reason
    FROM pred_m p JOIN (SELECT image_id, inst_id, count(*) FILTER (y IN (0, 255) OR x IN (0, 255)) AS b FROM pred_px GROUP BY ALL) e USING (image_id, inst_id)
    WHERE type_label = 'tidal_features'""")
def _(t):
    edge = shape.edge_touch_ratio(t.pred_of("tidal_features"), SIDE, SIDE)
    rule = P.StreamSanity(min_area=80, max_area_px=200, edge_touch_frac=0.05)
    return edge.select(*_ID, rule.reason(F.col("area"), F.col("edge_ratio"), SIDE, SIDE).alias("reject_reason"))


@query("p9_cross_type_conflict")
def _(t):
    streams, sats, _ = _cross(t)
    both = streams.withColumn("k", F.lit("tidal_features")).unionByName(sats.withColumn("k", F.lit("satellites")))
    return both.groupBy("k", *_ID).agg(F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area"))


def _cross(t):
    cols = [*_ID, "area", "solidity", "aspect_sym_moment", "curvature_ratio"]
    m = t.pred_m.select(*cols)
    return history.cross_type_conflict(
        t.pred_of("tidal_features").join(m, _ID), t.pred_of("satellites").join(m, _ID),
        drop_compact_stream_overlap=0.4, keep_stream_area_ratio=2.5)


@query("p9_conflict_actions")
def _(t):
    return _cross(t)[2]


def _with_conflict(t):
    c = conflicts(t).select("image_id", F.col("pred_id").alias("inst_id"), "matched_stream_id", "overlap_ratio_satellite", "overlap_ratio_stream")
    return t.sats.join(c, _ID)


def _history(t):
    return history.candidate_history(_with_conflict(t), SIDE, GATE, RELABEL, CORE, CONFLICT)


@query("p10_candidate_history", """
    SELECT image_id, inst_id, final_status, matched_stream_id,
      'raw_accept,metrics_filled,' || gate_reason
      || CASE WHEN gate_reason LIKE 'pass%' THEN ',' || prior_reason ELSE '' END
      || CASE WHEN gate_reason LIKE 'pass%' AND prior_reason LIKE 'pass%' THEN ',' || core_reason ELSE '' END
      || CASE WHEN gate_reason LIKE 'pass%' AND prior_reason LIKE 'pass%' AND core_reason NOT LIKE 'drop%' THEN ',' || conf_reason ELSE '' END
      || CASE final_status WHEN 'kept' THEN ',write_kept' WHEN 'relabeled_inner_galaxy' THEN ',write_relabeled_inner_galaxy' ELSE '' END AS reasons
    FROM hist""", ctes=ALL)
def _(t):
    return _history(t).select(*_ID, "final_status", "matched_stream_id", F.expr("array_join(history.reason, ',')").alias("reasons"))


@query("p10_history_events")
def _(t):
    return _history(t).select(*_ID, F.explode("history").alias("e")).select(*_ID, "e.*").drop("threshold_values", "metrics_snapshot_thin")


@query("p11_history_summary", """
    SELECT image_id, count(*) AS n_raw_satellites, count(*) FILTER (final_status = 'kept') AS n_final_satellites,
           count(*) FILTER (final_status = 'relabeled_inner_galaxy') AS n_final_inner_galaxy, count(*) FILTER (final_status = 'dropped') AS n_dropped,
           count(*) FILTER (drop_stage = 'size_aware_score_gate') AS drop_size_aware_score_gate,
           count(*) FILTER (drop_stage = 'satellite_prior_filter') AS drop_satellite_prior_filter,
           count(*) FILTER (drop_stage = 'core_exclusion_or_soft_core_rescue') AS drop_core_exclusion_or_soft_core_rescue,
           count(*) FILTER (drop_stage = 'stream_conflict_resolution') AS drop_stream_conflict_resolution,
           'score_gate_v1_static' AS v_score_gate, 'prior_v3_center_aware' AS v_prior_filter, 'core_policy_v1_strict' AS v_core_policy,
           'conflict_policy_v1_dr1' AS v_conflict_policy FROM hist GROUP BY image_id""", ctes=ALL)
def _(t):
    return history.history_summary(_history(t), GATE, RELABEL, CORE, CONFLICT)


CFG = post.PostConfig(sanity=P.StreamSanity(80, edge_touch_frac=0.05), gate=GATE, prior=PRIOR, core=CORE, conflict=None)


@query("p12_post_pred_only", """
    SELECT image_id, inst_id, type_label FROM traced WHERE first_drop_stage IS NULL
    UNION ALL SELECT p.image_id, p.inst_id, p.type_label FROM pred_m p
      JOIN (SELECT image_id, inst_id, count(*) FILTER (y IN (0, 255) OR x IN (0, 255)) AS b FROM pred_px GROUP BY ALL) e USING (image_id, inst_id)
      WHERE type_label = 'tidal_features' AND area >= 80 AND b::DOUBLE / area <= 0.05::DOUBLE""", ctes=RULES)
def _(t):
    out, _ = post.post_pred_only(t.pred_m, t.pred_runs, CFG, SIDE, SIDE, stream_label="tidal_features")
    return out.select(*_ID, "type_label").distinct()


@query("p12_with_conflict")
def _(t):
    cfg = post.PostConfig(CFG.sanity, GATE, PRIOR, CORE, {"drop_compact_stream_overlap": 0.4, "keep_stream_area_ratio": 2.5})
    out, _ = post.post_pred_only(t.pred_m, t.pred_runs, cfg, SIDE, SIDE, stream_label="tidal_features")
    return out.groupBy(*_ID, "type_label").agg(F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area"))


def trace(t):
    return history.satellite_trace(t.sats, SIDE, GATE, PRIOR, CORE)


@query("p13_post_with_trace", """
    SELECT image_id, inst_id, CASE WHEN first_drop_stage IS NULL THEN 'kept' ELSE 'removed' END AS final_status, first_drop_stage, first_drop_reason,
           CASE WHEN g_ok THEN 'pass' ELSE 'drop' END || ',' ||
           CASE WHEN NOT g_ok THEN 'not_reached' WHEN p_ok THEN 'pass' ELSE 'drop' END || ',' ||
           CASE WHEN NOT g_ok OR NOT p_ok THEN 'not_reached' ELSE split_part(core_reason, '_', 1) END AS outcomes FROM traced""", ctes=RULES)
def _(t):
    return trace(t).select(*_ID, "final_status", "first_drop_stage", "first_drop_reason",
                           F.expr("array_join(stage_results.outcome, ',')").alias("outcomes"))


@query("p15_filter_gt_by_type", "SELECT image_id, inst_id, count(*) AS area FROM gt_px WHERE type_label = 'satellites' GROUP BY ALL")
def _(t):
    wanted = t.gt.where("type_label = 'satellites'").select(*_ID)
    return R.areas(t.gt_runs.join(wanted, _ID, "left_semi"))


@query("p16_roi_centroid", """
    SELECT image_id, inst_id, cy >= 32 AND cy < 224 AND cx >= 32 AND cx < 224 AS in_roi FROM gt_m""")
def _(t):
    return t.gt_m.select(*_ID, P.in_roi(F.col("cx"), F.col("cy"), ROI).alias("in_roi"))


@query("p17_roi_any_pixel", """
    SELECT DISTINCT image_id, inst_id FROM gt_px WHERE y >= 32 AND y < 224 AND x >= 32 AND x < 224""")
def _(t):
    return R.window_fraction(t.gt_runs, ROI).where("inside_px > 0").select(*_ID)


@query("p18_official_scope", """
    SELECT mode, CASE mode WHEN 'gt_canonical' THEN 'full_frame' ELSE 'roi' END AS scope, count(*) AS n
    FROM (SELECT CASE WHEN image_id % 2 = 0 THEN 'gt_canonical' ELSE 'fbox_gold_satellites' END AS mode FROM images) GROUP BY ALL""")
def _(t):
    m = t.images.select(F.when(F.col("image_id") % 2 == 0, "gt_canonical").otherwise("fbox_gold_satellites").alias("mode"))
    return m.select("mode", P.official_scope(F.col("mode")).alias("scope")).groupBy("mode", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("p19_low_confidence_probe", """
    SELECT image_id, n_raw_total, n_raw_satellites, rank, inst_id, area, score FROM
      (SELECT image_id, count(*) AS n_raw_total, count(*) FILTER (type_label = 'satellites') AS n_raw_satellites
       FROM pred_m WHERE score >= 0.3::DOUBLE GROUP BY ALL)
      LEFT JOIN (SELECT * FROM (SELECT image_id, inst_id, area, score,
         row_number() OVER (PARTITION BY image_id ORDER BY area DESC, score DESC, inst_id) AS rank
         FROM pred_m WHERE score >= 0.3::DOUBLE AND type_label = 'satellites') WHERE rank <= 15) USING (image_id)""")
def _(t):
    from maskwright.operators.dataset import low_confidence_probe

    return low_confidence_probe(t.pred_m, low=0.3)


@query("p20_validate_label", """
    SELECT family, label, count(*) AS n FROM (
      SELECT CASE conv_id % 3 WHEN 0 THEN 'satellite_mv' WHEN 1 THEN 'satellite_ev' ELSE 'stream_ev' END AS family,
             CASE turn % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'confirm_complete' WHEN 2 THEN 'delete_fragment' ELSE 'route_to_ev' END AS label FROM conversations)
    WHERE NOT ((family = 'satellite_mv' AND label IN ('accept', 'minor_fix', 'reject', 'route_to_ev'))
      OR (family = 'satellite_ev' AND label IN ('confirm_complete', 'add_missing', 'confirm_empty'))
      OR (family = 'stream_ev' AND label IN ('confirm_complete', 'add_missing_fragment', 'delete_fragment', 'redraw', 'confirm_empty', 'uncertain'))) GROUP BY ALL""")
def _(t):
    from maskwright.operators.review import invalid_labels

    rows = t.conversations.select(
        F.expr("case conv_id % 3 when 0 then 'satellite_mv' when 1 then 'satellite_ev' else 'stream_ev' end").alias("family"),
        F.expr("case turn % 4 when 0 then 'accept' when 1 then 'confirm_complete' when 2 then 'delete_fragment' else 'route_to_ev' end").alias("label"))
    return invalid_labels(rows).groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))


@query("e22_require_render", """
    SELECT image_id, image_id % 5 <> 0 AS has_render FROM images""")
def _(t):
    from maskwright.operators.dataset import split_by_render

    have, missing = split_by_render(t.images, t.images.where("image_id % 5 <> 0"), ["image_id"])
    return have.withColumn("has_render", F.lit(True)).unionByName(missing.withColumn("has_render", F.lit(False)))
