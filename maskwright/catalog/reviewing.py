"""Named queries: weak labels, examples, hashes, corrections, audit log."""

from pyspark.sql import Window as W, functions as F

from maskwright.catalog import query
from maskwright.catalog.matching import _BANDS, _EXH, _MATCHES, candidate_matches, coverage
from maskwright.operators import match, review as V, runs as R
from maskwright.operators.replay import adopt, import_corrections, migrate_overrides

_C = {**_MATCHES, **_BANDS, **_EXH, "labelled": """
    SELECT m.*, f.boundary_f1, e.exhaustivity_confident, CASE
        WHEN filter_status IN ('prior_rejected', 'core_rejected') THEN 'reject' WHEN best_iou < 0.1::DOUBLE THEN 'reject'
        WHEN overlaps_multiple_gt OR (second_best_iou > 0 AND best_iou - second_best_iou < 0.15::DOUBLE) THEN NULL
        WHEN best_iou >= 0.7::DOUBLE AND area_ratio BETWEEN 0.5::DOUBLE AND 2.0::DOUBLE AND boundary_f1 >= 0.3::DOUBLE AND confidence_score >= 0.5::DOUBLE THEN 'accept'
        WHEN NOT e.exhaustivity_confident THEN 'route_to_ev' END AS decision_label,
      CASE WHEN filter_status IN ('prior_rejected', 'core_rejected') THEN 0.95::DOUBLE WHEN best_iou < 0.1::DOUBLE THEN 0.9::DOUBLE
        WHEN best_iou >= 0.7::DOUBLE AND area_ratio BETWEEN 0.5::DOUBLE AND 2.0::DOUBLE AND boundary_f1 >= 0.3::DOUBLE AND confidence_score >= 0.5::DOUBLE THEN best_iou ELSE 0.5::DOUBLE END AS confidence
    FROM cand_match m LEFT JOIN band_f1 f ON f.image_id = m.image_id AND f.pred_id = m.pred_id JOIN exh e ON e.image_id = m.image_id"""}


def _labels(t):
    return V.silver_mv(candidate_matches(t, bands=True), coverage(t))


@query("r1_silver_mv", "SELECT image_id, pred_id, decision_label, round(confidence, 4) AS confidence FROM labelled WHERE decision_label IS NOT NULL", ctes=_C)
def _(t):
    return _labels(t).select("image_id", "pred_id", "decision_label", "confidence")


@query("r2_silver_by_instance", """
    SELECT image_id, best_gt_id AS inst_id, 'inst_' || printf('%03d', best_gt_id) AS candidate_key, decision_label, round(confidence, 4) AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id, best_gt_id ORDER BY decision_label, confidence DESC, pred_id) AS rn FROM labelled
      WHERE best_gt_id IS NOT NULL AND decision_label IN ('accept', 'route_to_ev')) WHERE rn = 1""", ctes=_C)
def _(t):
    return V.silver_mv_by_instance(_labels(t))


@query("a33_spot_check_mv", """
    SELECT decision_label, count(*) AS n, min(best_iou) AS best_iou_min, max(best_iou) AS best_iou_max, quantile_cont(best_iou, 0.5) AS best_iou_median,
           count(*) FILTER (decision_label = 'accept' AND (best_iou < 0.7::DOUBLE OR confidence_score < 0.5::DOUBLE)) AS bad_accept,
           count(*) FILTER (decision_label = 'reject' AND best_iou > 0.7::DOUBLE AND area_ratio BETWEEN 0.5::DOUBLE AND 2.0::DOUBLE AND filter_status = 'kept') AS suspect_reject,
           count(*) FILTER (decision_label = 'accept' AND best_iou >= 0.7::DOUBLE AND best_iou < 0.7::DOUBLE + 0.05::DOUBLE) AS edge_accept,
           count(*) FILTER (decision_label <> 'accept' AND best_iou >= 0.7::DOUBLE - 0.05::DOUBLE AND best_iou < 0.7::DOUBLE) AS edge_other
    FROM labelled WHERE decision_label IS NOT NULL GROUP BY ALL""", doubles="best_iou_min best_iou_max best_iou_median", ctes=_C)
def _(t):
    return V.spot_check_mv(_labels(t)).select("decision_label", "n", "best_iou_min", "best_iou_max", "best_iou_median", "bad_accept", "suspect_reject", "edge_accept", "edge_other")


_VAR = {"ranked": "SELECT image_id, inst_id, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, inst_id) AS rk, count(*) OVER (PARTITION BY image_id) AS n FROM gt_m WHERE type_label = '{t}'",
        "variants": """
    SELECT image_id, 'gt_complete' AS variant_id, 'confirm_complete' AS decision_label, string_agg(inst_id::VARCHAR, ',' ORDER BY rk) AS visible, '' AS hidden, max(n) AS num_instances FROM ranked GROUP BY ALL
    UNION ALL SELECT image_id, 'drop_top' || least(max(n), {k}), '{label}', coalesce(string_agg(inst_id::VARCHAR, ',' ORDER BY rk) FILTER (rk > {k}), ''), string_agg(inst_id::VARCHAR, ',' ORDER BY rk) FILTER (rk <= {k}), max(n) FROM ranked GROUP BY ALL
    UNION ALL SELECT image_id, 'gt_empty', 'confirm_empty', '', '', 0 FROM images WHERE image_id NOT IN (SELECT image_id FROM ranked)"""}


def _variant_ctes(**kw):
    return {k: v.format(**kw) for k, v in _VAR.items()}


def variants(t, label="satellites", hide=3, missing="add_missing"):
    return V.ev_variants(t.gt_m.where(F.col("type_label") == label), t.images, hide, missing)


def _flat(df):
    return df.select("image_id", "variant_id", "decision_label", F.array_join("visible_instance_ids", ",").alias("visible"), F.array_join("hidden_instance_ids", ",").alias("hidden"), "num_instances")


@query("r3_ev_variants_satellites", "SELECT * FROM variants", ctes=_variant_ctes(t="satellites", k=3, label="add_missing"))
def _(t):
    return _flat(variants(t))


@query("r3_ev_variants_streams", "SELECT * FROM variants", ctes=_variant_ctes(t="tidal_features", k=1, label="add_missing_fragment"))
def _(t):
    return _flat(variants(t, "tidal_features", 1, "add_missing_fragment"))


@query("a33_spot_check_ev", "SELECT decision_label, variant_id, count(*) AS n, 0::BIGINT AS bad_overlap, 0::BIGINT AS bad_empty FROM variants GROUP BY ALL",
       ctes=_variant_ctes(t="satellites", k=3, label="add_missing"))
def _(t):
    return V.spot_check_ev(variants(t))


@query("a33_mv_ev_consistency", """
    SELECT count(*) FILTER (a) AS all_accept, count(*) FILTER (a AND ev = 'confirm_complete') AS consistent, count(*) FILTER (a AND ev <> 'confirm_complete') AS inconsistent,
           count(*) FILTER (a AND ev IS NULL) AS missing_ev, count(*) FILTER (a IS NOT NULL AND ev IS NOT NULL) AS in_both, count(*) FILTER (a IS NOT NULL AND ev IS NULL) AS mv_only,
           count(*) FILTER (a IS NULL) AS ev_only
    FROM (SELECT image_id, bool_and(decision_label = 'accept') AS a FROM labelled WHERE decision_label IS NOT NULL GROUP BY ALL)
    FULL JOIN (SELECT image_id, max(decision_label) AS ev FROM variants WHERE variant_id = 'gt_complete' GROUP BY ALL) USING (image_id)""",
       ctes={**_C, **_variant_ctes(t="satellites", k=3, label="add_missing")})
def _(t):
    return V.mv_ev_consistency(_labels(t), variants(t))


for _stream in (False, True):
    def _make(stream):
        sat = """CASE WHEN num_gt = 0 AND num_pred_unmatched = 0 THEN 'confirm_empty' WHEN num_gt_unmatched = 0 AND num_pred_unmatched = 0 THEN 'confirm_complete'
            WHEN num_pred_unmatched > 0 AND num_gt_unmatched = 0 THEN 'remove_fp' WHEN num_gt_unmatched > 0 AND num_pred_unmatched = 0 THEN 'add_missing'
            WHEN coalesce(unmatched_pred_area::DOUBLE / nullif(total_pred_area, 0), 0) >= coalesce(unmatched_gt_area::DOUBLE / nullif(total_gt_area, 0), 0) * 3 THEN 'remove_fp'
            WHEN coalesce(unmatched_gt_area::DOUBLE / nullif(total_gt_area, 0), 0) >= coalesce(unmatched_pred_area::DOUBLE / nullif(total_pred_area, 0), 0) * 3 THEN 'add_missing' END"""
        st = """CASE WHEN num_gt = 0 AND num_pred_unmatched = 0 THEN 'confirm_empty' WHEN exhaustivity_confident THEN 'confirm_complete'
            WHEN num_gt_unmatched > 0 THEN 'add_missing_fragment' WHEN num_pred_unmatched > 0 THEN 'delete_fragment' END"""

        @query("r4_ev_from_predictions" + ("_stream" if stream else ""), f"SELECT image_id, {st if stream else sat} AS decision_label FROM exh WHERE {st if stream else sat} IS NOT NULL",
               ctes={**_MATCHES, **_EXH})
        def _(t):
            return V.ev_from_predictions(coverage(t), stream=stream).select("image_id", "decision_label")

    _make(_stream)


# -- examples and hashes ---------------------------------------------------------------------

_RLE = """'{"counts":"' || y0 || 'a' || x0 || '","size":[' || y1 || ',' || x1 || ']}'"""
_EX = {"mv_ex": """
    SELECT g.image_id, g.inst_id, 's' || g.image_id AS sample_id, """ + _RLE + """ AS rle, min(p.x) AS bx, min(p.y) AS top, max(p.x) - min(p.x) + 1 AS bw, max(p.y) - min(p.y) + 1 AS bh
    FROM gt g JOIN gt_px p USING (image_id, inst_id) WHERE g.type_label = 'satellites' GROUP BY ALL""",
    "mv_hash": """
    SELECT *, sha256('satellite_mv' || chr(0) || sample_id || chr(0) || 'rev_00' || chr(0) || 'spec' || chr(0) || 'prompt' || chr(0) || rle || chr(0) ||
      '[' || bx || ',' || top || ',' || bw || ',' || bh || ']' || chr(0) || '[' || (bx + bw // 2) || ',' || (top + bh // 2) || ',384,"zero"]' || chr(0) || 'ctx' || chr(0) || 'authoritative' || chr(0) || inst_id) AS revision_hash FROM mv_ex"""}


def _mv(t):
    rle = V.rle_json(F.col("y1").cast("int"), F.col("x1").cast("int"), F.concat(F.col("y0").cast("string"), F.lit("a"), F.col("x0").cast("string")))
    inst = t.gt.where("type_label = 'satellites'").select("image_id", "inst_id", F.concat(F.lit("s"), F.col("image_id").cast("string")).alias("sample_id"),
                                                         rle.alias("rle_json"), F.lit("accept").alias("decision_label"))
    ctx = t.images.select(F.concat(F.lit("s"), F.col("image_id").cast("string")).alias("sample_id"), F.lit("ctx").alias("bare_context_sha1"))
    return V.examples_mv(inst, R.bboxes(t.gt_of("satellites")), ctx, "spec", "prompt")


@query("r5_examples_authoritative", """
    SELECT image_id, inst_id, 'inst_' || printf('%03d', inst_id) AS candidate_id, '[' || bx || ',' || top || ',' || bw || ',' || bh || ']' AS candidate_bbox_xywh,
           (bx + bw // 2)::INTEGER AS center_x, (top + bh // 2)::INTEGER AS center_y FROM mv_ex""", ctes=_EX)
def _(t):
    return _mv(t).select("image_id", "inst_id", "candidate_id", "candidate_bbox_xywh", "center_x", "center_y")


@query("r9_revision_hash", "SELECT image_id, inst_id, revision_hash FROM mv_hash", ctes=_EX)
def _(t):
    return _mv(t).select("image_id", "inst_id", "revision_hash")


@query("r6_examples_rejected", """
    SELECT p.image_id, p.inst_id, 'rej_raw_rejected_' || printf('%03d', p.inst_id) AS candidate_id, 'reject' AS decision_label FROM pred_m p
    WHERE type_label = 'satellites' AND NOT (score >= 0.6::DOUBLE)
      AND NOT EXISTS (SELECT 1 FROM sat_pairs s WHERE s.image_id = p.image_id AND s.pred_id = p.inst_id AND s.iou > 0.3::DOUBLE)""")
def _(t):
    sha = F.col("inst_id").cast("string").alias("candidate_rle_sha1")
    sample = F.concat(F.lit("s"), F.col("image_id").cast("string")).alias("sample_id")
    rej = V.reject_candidates(t.sats.select("image_id", "inst_id", sha, sample), t.sats.where("score >= 0.6D").select("image_id", sha), t.sat_pairs)
    ctx = t.images.select(sample, F.lit("ctx").alias("bare_context_sha1"))
    out = V.examples_mv(rej.withColumn("rle_json", F.col("candidate_rle_sha1")), R.bboxes(t.pred_of("satellites")), ctx, "spec", "prompt",
                        source="pre_merge_rejected", label=F.lit("reject"))
    return out.select("image_id", "inst_id", "candidate_id", "decision_label")


_STATE = {"mask_h": "SELECT image_id, inst_id, type_label, sha256(string_agg(y || ',' || x0 || ',' || x1, ';' ORDER BY y, x0)) AS m FROM gt_runs GROUP BY ALL",
          "state_h": "SELECT image_id, sha256(string_agg(inst_id || ':' || type_label || ':' || m, chr(10) ORDER BY inst_id)) AS annotation_state_hash FROM mask_h GROUP BY ALL"}


@query("r10_annotation_state_hash", "SELECT * FROM state_h", ctes=_STATE)
def _(t):
    return V.annotation_state_hash(t.gt_runs, t.gt)


def _ev(t):
    rle = F.concat_ws(",", "y0", "x0", "y1", "x1")
    inst = t.gt.select("image_id", "inst_id", "type_label", F.concat(F.lit('"'), rle, F.lit('"')).alias("rle_json"))
    images = t.images.select("image_id", F.concat(F.lit("s"), F.col("image_id").cast("string")).alias("sample_id"), F.lit("img").alias("review_image_sha1"))
    return V.examples_ev(variants(t), inst, V.annotation_state_hash(t.gt_runs, t.gt), images, "satellite_ev", "satellites", "spec", "prompt")


@query("r7_examples_ev", """
    SELECT v.image_id, v.variant_id, v.decision_label, coalesce(h.n, 0) AS n_hints, h.hh AS fragment_hints_hash,
           sha256('satellite_ev' || chr(0) || 's' || v.image_id || chr(0) || 'rev_00' || chr(0) || 'spec' || chr(0) || 'prompt' || chr(0) || 'img' || chr(0) || s.annotation_state_hash ||
                  CASE WHEN h.hh IS NOT NULL THEN chr(0) || h.hh ELSE '' END || chr(0) || v.variant_id) AS revision_hash
    FROM variants v JOIN state_h s USING (image_id) LEFT JOIN (
      SELECT r.image_id, vv.variant_id, count(*) AS n, sha256('[' || string_agg('{"instance_id": ' || r.inst_id || ', "rle": "' || concat_ws(',', y0, x0, y1, x1) || '"}', ', ' ORDER BY r.inst_id) || ']') AS hh
      FROM ranked r JOIN gt g ON g.image_id = r.image_id AND g.inst_id = r.inst_id
      JOIN (SELECT DISTINCT image_id, variant_id FROM variants WHERE variant_id <> 'gt_empty') vv ON vv.image_id = r.image_id WHERE vv.variant_id = 'gt_complete' OR r.rk > 3 GROUP BY ALL) h USING (image_id, variant_id)""",
    ctes={**_variant_ctes(t="satellites", k=3, label="add_missing"), **_STATE})
def _(t):
    return _ev(t).select("image_id", "variant_id", "decision_label", "n_hints", "fragment_hints_hash", "revision_hash")


@query("r8_example_ids", """
    SELECT image_id, inst_id, 'satell_' || printf('%06d', row_number() OVER (ORDER BY image_id, inst_id) - 1) AS example_id FROM mv_ex""", ctes=_EX)
def _(t):
    return V.with_example_ids(_mv(t), [F.col("image_id"), F.col("inst_id")]).select("image_id", "inst_id", "example_id")


@query("r11_context_dedup", """
    SELECT path, count(*) AS n_uses FROM (SELECT 'review_context/' || sample_id || '_v.png' AS path FROM mv_ex
      UNION ALL SELECT 'review_crops/' || sample_id || '/' || (bx + bw // 2) || '_' || (top + bh // 2) || '_384_zero_spec.png' FROM mv_ex) GROUP BY ALL""", ctes=_EX)
def _(t):
    req = _mv(t).select("sample_id", "center_x", "center_y", F.lit(384).alias("size"), F.lit("zero").alias("pad_mode"), F.lit("v").alias("variant"), F.lit("spec").alias("spec_id"))
    return V.dedupe_assets(req)


_CHAT = {"chat": """
    SELECT c.conv_id || '_' || turn AS example_id, CASE WHEN turn % 2 = 0 THEN 'satellite_mv' ELSE 'stream_ev' END AS task_family,
           '{"messages":[{"content":[{"text":"<tok> look","type":"text"},' || CASE WHEN turn % 2 = 0 THEN '{"path":"crop","type":"image"},{"path":"ctx","type":"image"}' ELSE '{"path":"img","type":"image"}' END ||
           '],"role":"user"},{"content":"' || role || '","role":"assistant"}],"metadata":{"example_id":"' || c.conv_id || '_' || turn || '","fixed_prompt_id":"p","revision_hash":"' || sha256(c.conv_id || '_' || turn) || '"}}' AS line
    FROM conversations c"""}


def _chat(t):
    ex = t.conversations.select(F.concat_ws("_", "conv_id", "turn").alias("example_id"), F.when(F.col("turn") % 2 == 0, "satellite_mv").otherwise("stream_ev").alias("task_family"),
                                F.col("role").alias("decision_label"), F.lit("p").alias("fixed_prompt_id"), F.sha2(F.concat_ws("_", "conv_id", "turn"), 256).alias("revision_hash"),
                                F.lit("crop").alias("crop_path"), F.lit("ctx").alias("context_path"), F.lit("img").alias("review_image_path"))
    prompts = t.spark.createDataFrame([("p", "<tok>", "look")], "fixed_prompt_id string, isolation_token string, text_template string")
    return V.chat_rows(ex, prompts)


@query("r12_chat_rows", "SELECT example_id, task_family, line FROM chat", ctes=_CHAT)
def _(t):
    return _chat(t)


_HASH = {**_CHAT, "per": """
    SELECT task_family, substr(sha256(example_id), 1, 3) AS b, count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS s0, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS s1,
           sum(('0x' || substr(h, 31, 15))::HUGEINT) AS s2, sum(('0x' || substr(h, 46, 15))::HUGEINT) AS s3 FROM (SELECT *, sha256(line) AS h FROM chat) GROUP BY ALL""",
         "tree": """
    SELECT {f} sum(n)::BIGINT AS num_records, sha256(string_agg(b || ':' || n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3, chr(10) ORDER BY b || ':' || n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3)) AS content_sha256
    FROM {p} GROUP BY ALL"""}


@query("r12_content_hash", "SELECT * FROM tree", ctes={**_HASH, "tree": _HASH["tree"].format(
    f="", p="(SELECT b, sum(n)::BIGINT AS n, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3 FROM per GROUP BY b)")})
def _(t):
    return V.content_hash(_chat(t), "example_id")


@query("r13_round_contents", "SELECT * FROM tree", ctes={**_HASH, "tree": _HASH["tree"].format(f="task_family,", p="per")})
def _(t):
    """Number of records and digest of each family of a round."""
    rows = _chat(t)
    parts = [V.content_hash(rows.where(F.col("task_family") == f), "example_id").withColumn("task_family", F.lit(f)) for f in ("satellite_mv", "stream_ev")]
    return parts[0].unionByName(parts[1])


# -- corrections: orders as correction lines, events as the log -------------------------------

def _corrections(t):
    k = F.col("o_orderkey") % 4
    return t.orders.select(
        F.col("o_custkey").cast("long").alias("sample_id"), F.col("o_orderkey").cast("long").alias("line_no"),
        F.when(k == 0, "satellite_mv").when(k == 1, "satellite_ev").otherwise("stream_ev").alias("task_family"),
        F.when(k == 2, "drop_top1").when(k == 1, "gt_complete").alias("variant_id"),
        F.when(F.col("o_orderkey") % 12 == 0, "pre_merge_rejected").otherwise("authoritative").alias("candidate_source"),
        F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderkey").cast("long")).alias("inst_id"), (F.col("o_orderkey") % 7 != 0).alias("is_current"))


_COR = {"cor": """
    SELECT o_custkey::BIGINT AS sample_id, o_orderkey::BIGINT AS line_no, CASE WHEN o_orderkey % 7 = 0 THEN 'stale_revision' WHEN o_orderkey % 4 = 2 THEN 'variant_not_safe'
      WHEN o_orderkey % 4 = 0 AND o_orderkey % 12 = 0 THEN 'rejected_candidate' WHEN o_orderkey % 4 = 0 AND o_orderkey % 20 = 0 THEN 'no_instance' END AS why, o_orderkey % 4 <> 0 AS ev FROM orders""",
    "outc": """
    SELECT c.sample_id, line_no, CASE WHEN ev AND line_no > f.first THEN 'stale_revision' ELSE why END AS refusal
    FROM cor c LEFT JOIN (SELECT sample_id, min(line_no) AS first FROM cor WHERE why IS NULL GROUP BY ALL) f USING (sample_id)"""}


@query("r16_write_back_refusals", "SELECT sample_id, line_no, why AS refusal FROM cor", ctes=_COR)
def _(t):
    return V.write_back_refusals(_corrections(t)).select("sample_id", "line_no", "refusal")


@query("r17_import_outcomes", "SELECT sample_id, line_no, refusal, CASE WHEN refusal IS NULL THEN 'OK' ELSE 'rejected' END AS outcome FROM outc", ctes=_COR)
def _(t):
    return V.import_outcomes(_corrections(t)).select("sample_id", "line_no", "refusal", "outcome")


@query("r17_re_export_keys", "SELECT DISTINCT sample_id FROM outc WHERE refusal IS NULL", ctes=_COR)
def _(t):
    return V.re_export_keys(V.import_outcomes(_corrections(t)))


# The whole import: predictions as correction lines over the label map of the ground truth. A line's recorded
# state is that of the start or, for some, what the last rewrite of its image leaves.

def _digest(px: str, ids: str) -> str:
    """The state digest of lists of runs and of instances, in SQL."""
    own = f"list_filter({px}, lambda e: e.i = k)"
    text = f"array_to_string(list_transform(list_sort(list_transform({own}, lambda e: struct_pack(y := e.y, a := e.a, b := e.b))), lambda e: e.y || ',' || e.a || ',' || e.b), ';')"
    keys = f"list_sort(list_distinct(list_concat(list_transform({ids}, lambda e: e.i), list_transform({px}, lambda e: e.i))))"
    return (f"sha256(array_to_string(list_transform({keys}, lambda k: k || ':' || coalesce(list_filter({ids}, lambda e: e.i = k)[1].t, '') || ':' || "
            f"CASE WHEN len({own}) = 0 THEN '' ELSE sha256({text}) END), chr(10)))")


_ZERO = "|| chr(0) ||"
_IMPORT = {
    "payload": """
    SELECT image_id, inst_id, type_label, list(struct_pack(y := y, a := x0, b := x1) ORDER BY y) AS m, sha256(string_agg(y || ',' || x0 || ',' || x1, ';' ORDER BY y)) AS mh
    FROM pred_runs GROUP BY ALL""",
    "owner": "SELECT image_id, y, x, max(inst_id) AS i FROM gt_px GROUP BY ALL",
    "runs0": """
    SELECT image_id, i, y, min(x)::BIGINT AS a, max(x)::BIGINT + 1 AS b FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, i, y ORDER BY x) AS g FROM owner) GROUP BY image_id, i, y, g""",
    "init": f"""
    SELECT image_id, coalesce(px, []) AS px, coalesce(ids, []) AS ids, {_digest("coalesce(px, [])", "coalesce(ids, [])")} AS h0 FROM (SELECT DISTINCT image_id FROM payload)
    LEFT JOIN (SELECT image_id, list(struct_pack(y := y::BIGINT, a := a, b := b, i := i) ORDER BY y, a) AS px FROM runs0 GROUP BY image_id) USING (image_id)
    LEFT JOIN (SELECT image_id, list(struct_pack(i := inst_id, t := type_label) ORDER BY inst_id) AS ids FROM gt GROUP BY image_id) USING (image_id)""",
    "lined": """
    SELECT image_id, inst_id AS line_no, type_label AS label, m, 's' || image_id AS sample_id, 'rev_' || inst_id AS rev, h0,
      CASE inst_id % 3 WHEN 0 THEN 'satellite_mv' WHEN 1 THEN 'satellite_ev' ELSE 'stream_ev' END AS family,
      CASE WHEN inst_id % 11 = 7 THEN 'drop_top1' WHEN inst_id % 11 = 3 THEN 'gt_complete' END AS variant,
      CASE WHEN inst_id % 12 = 0 THEN 'pre_merge_rejected' ELSE 'authoritative' END AS source, CASE WHEN inst_id % 9 <> 0 THEN inst_id END AS target,
      last_value(CASE WHEN inst_id % 3 = 1 THEN sha256(inst_id || ':' || type_label || ':' || mh) END IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY inst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      row_number() OVER (PARTITION BY image_id ORDER BY inst_id) AS rn
    FROM payload JOIN init USING (image_id)""",
    "lines": f"""
    SELECT *, family {_ZERO} sample_id {_ZERO} rev {_ZERO} 'spec' {_ZERO} 'prompt' {_ZERO} 'img' || chr(0) AS head, coalesce(chr(0) || variant, '') AS tail,
      CASE WHEN family <> 'satellite_mv' THEN sha256(family {_ZERO} sample_id {_ZERO} rev {_ZERO} 'spec' {_ZERO} 'prompt' {_ZERO} 'img' {_ZERO} CASE WHEN line_no % 4 <> 1 AND before IS NOT NULL THEN before ELSE h0 END || coalesce(chr(0) || variant, ''))
        WHEN line_no % 7 = 0 THEN 'old' ELSE sha256('satellite_mv' {_ZERO} sample_id {_ZERO} rev {_ZERO} 'spec' {_ZERO} 'prompt' {_ZERO} 'm' {_ZERO} 'b' {_ZERO} 'c' {_ZERO} 'ctx' {_ZERO} source {_ZERO} coalesce(target::VARCHAR, '')) END AS rh
    FROM lined""",
    "rec": f"""
    SELECT image_id, 0::BIGINT AS rn, px, ids, NULL::VARCHAR AS refusal, '' AS state_hash FROM init
    UNION ALL
    SELECT image_id, rn, px, ids, refusal, CASE WHEN refusal IS NULL AND family <> 'satellite_mv' THEN {_digest("px", "ids")} ELSE '' END FROM (
      SELECT image_id, rn, refusal, family, CASE WHEN refusal IS NULL THEN list_concat(
          flatten(list_transform(kept, lambda e: CASE WHEN len(list_filter(m, lambda x: x.y = e.y AND x.a < e.b AND x.b > e.a)) = 0 THEN [e] ELSE list_filter([
            struct_pack(y := e.y, a := e.a, b := least(e.b, list_filter(m, lambda x: x.y = e.y)[1].a), i := e.i),
            struct_pack(y := e.y, a := greatest(e.a, list_filter(m, lambda x: x.y = e.y)[1].b), b := e.b, i := e.i)], lambda z: z.a < z.b) END)),
          list_transform(m, lambda x: struct_pack(y := x.y, a := x.a, b := x.b, i := line_no))) ELSE px END AS px,
        CASE WHEN refusal IS NOT NULL OR family = 'satellite_mv' THEN ids WHEN family = 'satellite_ev' THEN [struct_pack(i := line_no, t := label)]
          ELSE list_append(list_filter(ids, lambda e: e.t <> 'tidal_features'), struct_pack(i := line_no, t := 'tidal_features')) END AS ids
      FROM (
        SELECT r.image_id, l.rn, l.line_no, l.label, l.m, l.family, r.px, r.ids,
          CASE l.family WHEN 'satellite_mv' THEN list_filter(r.px, lambda e: e.i <> l.line_no) WHEN 'satellite_ev' THEN r.px[1:0]
            ELSE list_filter(r.px, lambda e: NOT list_contains(list_transform(list_filter(r.ids, lambda d: d.t = 'tidal_features'), lambda d: d.i), e.i)) END AS kept,
          CASE WHEN l.family = 'satellite_mv' THEN CASE WHEN l.rh = 'old' THEN 'stale_revision' WHEN l.source <> 'authoritative' THEN 'rejected_candidate' WHEN l.target IS NULL THEN 'no_instance' END
            WHEN sha256(l.head || {_digest("r.px", "r.ids")} || l.tail) <> l.rh THEN 'stale_revision' WHEN l.variant NOT IN ('gt_complete', 'gt_empty') THEN 'variant_not_safe'
            WHEN l.family = 'stream_ev' AND len(list_filter(r.ids, lambda d: d.i = l.line_no AND d.t = 'tidal_features')) = 0 THEN 'not_a_stream' END AS refusal
        FROM rec r JOIN lines l ON l.image_id = r.image_id AND l.rn = r.rn + 1))""",
    "imported": f"""
    SELECT image_id, line_no, family, refusal, rev, rh, CASE WHEN refusal IS NULL THEN 'rev_' || substr(sha256(rev || ':' || line_no || ':' || rh), 1, 8) END AS new_rev, CASE WHEN refusal IS NULL THEN CASE WHEN family = 'satellite_mv'
        THEN sha256('satellite_mv' {_ZERO} sample_id {_ZERO} 'rev_' || substr(sha256(rev || ':' || line_no || ':' || rh), 1, 8) {_ZERO} 'spec' {_ZERO} 'prompt' {_ZERO} 'm' {_ZERO} 'b' {_ZERO} 'c' {_ZERO} 'ctx' {_ZERO} source {_ZERO} target)
        ELSE sha256(family {_ZERO} sample_id {_ZERO} 'rev_' || substr(sha256(rev || ':' || line_no || ':' || rh), 1, 8) {_ZERO} 'spec' {_ZERO} 'prompt' {_ZERO} 'img' {_ZERO} state_hash || tail) END END AS new_hash
    FROM rec JOIN lines USING (image_id, rn)""",
    "last_state": "SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) = 1",
}


def _imported(t):
    runs = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")])))
    payload = t.pred_runs.groupBy("image_id", "inst_id", "type_label").agg(runs.alias("runs"))
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("y", "x0", "x1")])), ";")
    single = F.sha2(F.concat_ws(":", F.col("inst_id").cast("string"), "type_label", F.sha2(text, 256)), 256)
    label_map = R.merge_tiles(R.paint(t.gt_runs, F.col("inst_id")), ["image_id", "inst_id"])
    kept = label_map.select("image_id", "inst_id", "y", "x0", "x1")
    start = V.annotation_state_hash(kept, t.gt).withColumnRenamed("annotation_state_hash", "h0")
    k = F.col("inst_id")
    before = F.last(F.when(k % 3 == 1, single), ignorenulls=True).over(W.partitionBy("image_id").orderBy("inst_id").rowsBetween(W.unboundedPreceding, -1))
    family = F.when(k % 3 == 0, "satellite_mv").when(k % 3 == 1, "satellite_ev").otherwise("stream_ev")
    rows = payload.join(start, "image_id", "left").select(
        "image_id", k.alias("line_no"), F.concat(F.lit("s"), F.col("image_id").cast("string")).alias("sample_id"), F.concat(F.lit("rev_"), k.cast("string")).alias("task_revision_id"),
        family.alias("task_family"), F.when(k % 11 == 7, "drop_top1").when(k % 11 == 3, "gt_complete").alias("variant_id"),
        F.when(k % 12 == 0, "pre_merge_rejected").otherwise("authoritative").alias("candidate_source"), F.when(k % 9 != 0, k).alias("inst_id"),
        *[F.lit(v).alias(c) for c, v in (("render_spec_id", "spec"), ("fixed_prompt_id", "prompt"), ("review_image_sha1", "img"), ("mask_json", "m"), ("box_json", "b"), ("crop_json", "c"), ("context_sha1", "ctx"))],
        F.lit(None).cast("string").alias("fragment_hints_hash"), F.array(F.struct(k.alias("inst_id"), "type_label", "runs")).alias("masks"),
        before.alias("before"), F.coalesce("h0", F.sha2(F.lit(""), 256)).alias("h0"))
    state = F.when((F.col("line_no") % 4 != 1) & F.col("before").isNotNull(), F.col("before")).otherwise(F.col("h0"))
    parts = [F.col(c) for c in ("sample_id", "task_revision_id", "render_spec_id", "fixed_prompt_id")]
    ev = V.revision_hash_ev(F.col("task_family"), *parts, F.col("review_image_sha1"), state, F.lit(None).cast("string"), F.col("variant_id"))
    mv = V.revision_hash_mv(*parts, *[F.col(c) for c in ("mask_json", "box_json", "crop_json", "context_sha1", "candidate_source", "inst_id")])
    recorded = F.when(F.col("task_family") != "satellite_mv", ev).when(F.col("line_no") % 7 == 0, "old").otherwise(mv)
    return import_corrections(rows.withColumn("revision_hash", recorded).drop("before", "h0"), t.gt.select("image_id", "inst_id", "type_label"), kept, stream_label="tidal_features")


@query("r17_import_lines", """
    SELECT image_id, line_no, family AS task_family, refusal, CASE WHEN refusal IS NULL THEN 'OK' ELSE 'rejected' END AS outcome, new_rev AS new_task_revision_id, new_hash AS new_revision_hash FROM imported""", ctes=_IMPORT)
def _(t):
    return _imported(t).outcomes.select("image_id", "line_no", "task_family", "refusal", "outcome", "new_task_revision_id", "new_revision_hash")


@query("r17_new_state", """
    SELECT image_id, i AS inst_id, t AS type_label, coalesce(area, 0)::BIGINT AS area, mask_sha256 FROM (
      SELECT image_id, e.i AS i, sum(e.b - e.a) AS area, sha256(string_agg(e.y || ',' || e.a || ',' || e.b, ';' ORDER BY e.y, e.a)) AS mask_sha256 FROM (SELECT image_id, unnest(px) AS e FROM last_state) GROUP BY ALL)
    FULL JOIN (SELECT image_id, e.i AS i, e.t AS t FROM (SELECT image_id, unnest(ids) AS e FROM last_state)) USING (image_id, i)""", ctes=_IMPORT)
def _(t):
    """State of the samples with lines after the batch; painted ids that are not listed have no type."""
    done = _imported(t)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))), lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("y", "x0", "x1")])), ";")
    masks = done.runs.groupBy("image_id", "inst_id").agg(F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area"), F.sha2(text, 256).alias("mask_sha256"))
    both = done.instances.join(masks, ["image_id", "inst_id"], "full_outer").join(t.pred.select("image_id").distinct(), "image_id", "left_semi")
    return both.select("image_id", "inst_id", "type_label", F.coalesce("area", F.lit(0)).cast("long").alias("area"), "mask_sha256")


@query("r17_links", """
    SELECT rev AS original_task_revision_id, new_rev AS correction_task_revision_id, rh AS original_revision_hash, new_hash AS new_revision_hash, 'superseded' AS status FROM imported WHERE refusal IS NULL""", ctes=_IMPORT)
def _(t):
    return _imported(t).links.drop("seq")


@query("r14_superseded", """
    SELECT o_orderkey::BIGINT AS task_revision_id, o_custkey IN (SELECT o_custkey FROM orders GROUP BY ALL HAVING arg_max(o_orderstatus, o_orderkey) <> 'P') AS is_superseded FROM orders""")
def _(t):
    links = t.orders.select(F.col("o_custkey").alias("original_task_revision_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "active").otherwise("superseded").alias("status"))
    tasks = t.orders.select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_custkey").alias("task_revision_id"))
    return V.superseded(tasks, links).select(F.col("key").alias("task_revision_id"), "is_superseded")


@query("r15_stale_check", """
    SELECT image_id, annotation_state_hash = now_h AS is_current FROM state_h JOIN (
      SELECT image_id, sha256(string_agg(inst_id || ':' || type_label || ':' || m, chr(10) ORDER BY inst_id)) AS now_h FROM mask_h WHERE inst_id % 40 <> 0 GROUP BY ALL) USING (image_id)""", ctes=_STATE)
def _(t):
    rec = V.annotation_state_hash(t.gt_runs, t.gt).withColumnRenamed("annotation_state_hash", "revision_hash")
    now = V.annotation_state_hash(t.gt_runs.where("inst_id % 40 <> 0"), t.gt.where("inst_id % 40 <> 0")).withColumnRenamed("annotation_state_hash", "revision_hash")
    return V.stale_check(rec.join(now.select("image_id"), "image_id", "left_semi"), now, ["image_id"]).select("image_id", "is_current")


@query("r16_replace_instance", """
    SELECT image_id, inst_id, count(*) AS area FROM (
      SELECT image_id, inst_id, y, x FROM fix UNION ALL
      SELECT image_id, inst_id, y, x FROM gt_px g WHERE (image_id, inst_id) NOT IN (SELECT DISTINCT image_id, inst_id FROM fix) AND (image_id, y, x) NOT IN (SELECT image_id, y, x FROM fix)) GROUP BY ALL""",
    ctes={"fix": "SELECT p.image_id, p.inst_id, y, x FROM pred_px p JOIN gt g USING (image_id, inst_id) WHERE inst_id % 3 = 0"})
def _(t):
    fix = t.pred_runs.where("inst_id % 3 = 0").join(t.gt.select("image_id", "inst_id"), ["image_id", "inst_id"], "left_semi")
    return R.areas(V.replace_instance(t.gt_runs, fix))


@query("r16_rewrite_streams", """
    SELECT image_id, inst_id FROM pred WHERE inst_id % 5 = 0 AND (image_id, inst_id) NOT IN (SELECT image_id, inst_id FROM gt WHERE type_label = 'tidal_features')""")
def _(t):
    """Ids that are refused because they are no streams."""
    return V.rewrite_streams(t.gt_runs, t.gt, t.pred_runs.where("inst_id % 5 = 0"), "tidal_features")[1].select("image_id", "inst_id")


_LOG = {"log": """
    SELECT user_id::BIGINT AS image_id, CASE WHEN event_type = 'purchase' THEN event_id % 250 END AS a, CASE WHEN event_type = 'error' THEN event_id % 240 END AS d,
           CASE event_type WHEN 'signup' THEN 'failed' WHEN 'purchase' THEN 'committed' ELSE 'prepared' END AS status FROM events"""}


def audit_log(t):
    e = F.col("event_type")
    return t.events.select(
        F.col("user_id").cast("long").alias("image_id"), "ts", "event_id", F.when(e == "signup", "failed").when(e == "purchase", "committed").otherwise("prepared").alias("status"),
        F.when(e == "purchase", (F.col("event_id") % 250).cast("long")).alias("assigned_instance_id"), F.when(e == "error", (F.col("event_id") % 240).cast("long")).alias("deleted_instance_id"),
        F.when(e == "error", "delete_authoritative_satellite").otherwise("adopt_raw_satellite").alias("operation"))


@query("r20_audit_fold", """
    SELECT image_id, count(DISTINCT v) AS n_reserved, max(v)::BIGINT AS max_reserved_id FROM (SELECT image_id, unnest([a, d]) AS v FROM log WHERE status <> 'failed') WHERE v IS NOT NULL GROUP BY ALL""", ctes=_LOG)
def _(t):
    return V.audit_fold(audit_log(t))


def _numbered(t):
    """Ground truth as label map with small ids, in the order of the old ones; larger ones on top."""
    from maskwright.operators.numbering import number_rows

    inst = number_rows(t.gt.select("image_id", F.col("inst_id").alias("old"), "type_label"), ["image_id"], [F.col("old")], "inst_id")
    runs = t.gt_runs.withColumnRenamed("inst_id", "old").join(inst.select("image_id", "old", "inst_id"), ["image_id", "old"])
    return inst, R.paint(runs.select("image_id", "inst_id", "y", "x0", "x1"), F.col("inst_id"))


def _adopt(t):
    inst, runs = _numbered(t)
    for c in V.SOURCE:
        inst = inst.withColumn(c, F.when(F.col("old") % 6 == 0, (F.col("old") % 50).cast("string")))
    req = t.pred.select("image_id", F.col("inst_id").alias("request_id"), "type_label", *[(F.col("inst_id") % 50).cast("string").alias(c) for c in V.SOURCE],
                        F.when(F.col("inst_id") % 3 == 0, "by hand").alias("manual_note"), F.when(F.col("image_id") % 11 == 3, "pseudo").otherwise("authoritative").alias("label_mode"))
    return adopt(req, inst.drop("old"), runs, t.pred_runs.withColumnRenamed("inst_id", "request_id"), audit_log(t), min_area=40)


_LIMIT = 255
_START = {**_LOG, "numbered": "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) AS nr FROM gt",
          "used": "SELECT image_id, max(v) AS v FROM (SELECT image_id, nr AS v FROM numbered UNION ALL SELECT image_id, unnest([a, d]) FROM log WHERE status <> 'failed') GROUP BY ALL",
          "covered": "SELECT image_id, bitstring_agg((y * 256 + x)::INT, 0, 65535) AS bits FROM gt_px GROUP BY ALL",
          "begin_at": """
    SELECT i.image_id, coalesce(c.bits, bitstring('0', 65536)) AS taken, coalesce(u.v, 0)::BIGINT AS top, []::VARCHAR[] AS sources
    FROM images i LEFT JOIN covered c USING (image_id) LEFT JOIN used u USING (image_id)"""}


def _adopting(requests: str, least: int) -> dict[str, str]:
    """Requests (image_id, request_id, rn, type_label, source, had, mode, px, bits, note) one after the other."""
    return {"asked": requests, "turns": f"""
    SELECT image_id, 0::BIGINT AS rn, taken, top, sources, NULL::VARCHAR AS outcome, NULL::BIGINT AS area, []::BIGINT[] AS free FROM begin_at
    UNION ALL
    SELECT image_id, rn, CASE WHEN outcome = 'adopted' THEN taken | bits ELSE taken END, CASE WHEN outcome = 'adopted' THEN top + 1 ELSE top END,
      CASE WHEN outcome = 'adopted' THEN list_append(sources, source) ELSE sources END, outcome, CASE WHEN outcome IN ('adopted', 'empty_crop', 'area_too_small') THEN len(free) END, free FROM (
      SELECT *, CASE WHEN mode <> 'authoritative' THEN 'not_authoritative' WHEN type_label <> 'satellites' THEN 'unsupported_type' WHEN had OR list_contains(sources, source) THEN 'duplicate'
        WHEN top >= {_LIMIT} THEN 'id_overflow' WHEN len(free) = 0 THEN 'empty_crop' WHEN len(free) < {least} THEN 'area_too_small' ELSE 'adopted' END AS outcome FROM (
        SELECT a.*, t.taken, t.top, t.sources, list_filter(a.px, lambda p: get_bit(t.taken, p::INT) = 0) AS free FROM turns t JOIN asked a ON a.image_id = t.image_id AND a.rn = t.rn + 1))""",
            "boxed": """
    SELECT image_id, request_id, outcome, CASE WHEN outcome = 'adopted' THEN top END AS inst_id, area, note, source, CASE WHEN outcome = 'adopted' THEN area::DOUBLE /
        ((list_max(free) // 256 - list_min(free) // 256 + 1) * (list_max(list_transform(free, lambda p: p % 256)) - list_min(list_transform(free, lambda p: p % 256)) + 1)) END AS fill
    FROM turns JOIN asked USING (image_id, rn)"""}


_MASK_BITS = "SELECT image_id, inst_id, list((y * 256 + x)::BIGINT ORDER BY y, x) AS px, bitstring_agg((y * 256 + x)::INT, 0, 65535) AS bits FROM pred_px GROUP BY ALL"
_ADOPT = {**_START, "drawn": _MASK_BITS, **_adopting("""
    SELECT p.image_id, p.inst_id AS request_id, row_number() OVER (PARTITION BY p.image_id ORDER BY p.inst_id) AS rn, type_label, (p.inst_id % 50)::VARCHAR AS source,
      (p.image_id, p.inst_id % 50) IN (SELECT image_id, inst_id % 50 FROM gt WHERE type_label = 'satellites' AND inst_id % 6 = 0) AS had,
      CASE WHEN p.image_id % 11 = 3 THEN 'pseudo' ELSE 'authoritative' END AS mode, px, bits, CASE WHEN p.inst_id % 3 = 0 THEN 'by hand' END AS note
    FROM pred p JOIN drawn USING (image_id, inst_id)""", 40)}


@query("r18_adopt", "SELECT image_id, request_id, outcome, inst_id AS assigned_instance_id, area AS cropped_area_px FROM boxed", ctes=_ADOPT)
def _(t):
    return _adopt(t).verdicts.select("image_id", "request_id", "outcome", "assigned_instance_id", "cropped_area_px")


@query("r18_provenance", """
    SELECT image_id, inst_id, 'satellites' AS type_label, 'manual_adopted' AS label_source, source AS source_candidate_id, area AS area,
      CASE WHEN fill >= 0.1::DOUBLE THEN note ELSE concat_ws(' | ', note, 'warning:bbox_fill_lt_0.10 (' || printf('%.4f', fill) || ')') END AS manual_note,
      substr(sha256(concat_ws(':', image_id, request_id, source, source, source)), 1, 32) AS operation_id FROM boxed WHERE outcome = 'adopted'""", ctes=_ADOPT)
def _(t):
    """Instance rows that adoption adds, with the pixels they really got."""
    done = _adopt(t)
    return done.instances.join(R.areas(done.runs), ["image_id", "inst_id"]).select("image_id", "inst_id", "type_label", "label_source", "source_candidate_id", "area", "manual_note", "operation_id")


@query("r18_log", """
    SELECT image_id, request_id, unnest(['prepared', 'committed']) AS status, 'adopt_raw_satellite' AS operation, inst_id AS assigned_instance_id, area AS cropped_area_px, fill AS bbox_fill
    FROM boxed WHERE outcome = 'adopted'""", ctes=_ADOPT, doubles="bbox_fill")
def _(t):
    return _adopt(t).log.select("image_id", "request_id", "status", "operation", "assigned_instance_id", "cropped_area_px", "bbox_fill")


@query("r19_delete", """
    SELECT p.image_id, p.inst_id, CASE WHEN g.inst_id IS NULL THEN 'missing' WHEN g.type_label <> 'satellites' THEN 'unsupported_type' ELSE 'deleted' END AS outcome
    FROM pred p LEFT JOIN gt g USING (image_id, inst_id)""")
def _(t):
    out, _ = V.delete_instances(t.pred.select("image_id", "inst_id"), t.gt, audit_log(t))
    return out.select("image_id", "inst_id", "outcome")


@query("r21_override_summary", """
    SELECT rule, count(*) FILTER (NOT bad) AS ok, count(*) FILTER (bad) AS failed, 0::BIGINT AS skipped_dry_run FROM (
      SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'force_drop' ELSE 'force_keep' END AS rule, o_orderkey % 10 = 0 AS bad FROM orders) GROUP BY ALL""")
def _(t):
    entry = F.struct(F.col("o_orderkey").cast("string").alias("candidate_rle_sha1"), F.lit(None).cast("string").alias("candidate_id"), F.lit(None).cast("long").alias("raw_index"), F.lit(None).cast("string").alias("note"))
    drop = F.col("o_orderkey") % 3 == 0
    inject = F.struct(F.col("o_orderkey").cast("string").alias("candidate_rle_sha1"), F.lit("outside.json").alias("path"))
    ov = t.orders.select(F.col("o_custkey").cast("string").alias("base_key"), F.when(~drop, F.array(entry)).otherwise(F.array()).alias("force_keep"),
                         F.when(drop, F.array(entry)).otherwise(F.array()).alias("force_drop"), F.array(inject).alias("inject_from_json"))
    routed = V.route_overrides(ov)
    return V.override_summary(routed.withColumn("error", F.when(F.col("candidate_rle_sha1").cast("long") % 10 == 0, "failed")))


# Overrides: predictions as kept and dropped entries. Hashes and ids repeat inside an image, so selectors can be ambiguous.

_KEY = 10_000_000


def _overrides(t, dry_run=False):
    k, image = F.col("inst_id"), F.col("image_id")
    sha, cid = F.concat(F.lit("h"), (k % 40).cast("string")), F.concat(F.lit("c"), (k % 7).cast("string"))
    both = t.pred.select("image_id", "inst_id", "type_label", sha.alias("candidate_rle_sha1"), cid.alias("candidate_id"), k.alias("raw_index"), (image * _KEY + k).alias("pred_id"))
    native = both.withColumn("doc", F.concat(F.lit("raw:"), image.cast("string")))
    outside = native.where("image_id % 4 = 0 and inst_id % 40 in (1, 2, 3, 4)").withColumn("_n", F.row_number().over(W.partitionBy(k % 40).orderBy("pred_id"))).where("_n = 1").drop("_n").withColumn("doc", F.lit("outside.json"))
    predictions = native.unionByName(outside)
    masks = t.pred_runs.join(predictions.select("image_id", "inst_id", "doc", "pred_id"), ["image_id", "inst_id"])
    silent = k % 14 == 0
    entry = F.struct(F.when((k % 6).isin(0, 3) & ~silent, sha).alias("candidate_rle_sha1"), F.when(((k % 6).isin(1, 2) | (k % 12 == 0)) & ~silent, cid).alias("candidate_id"),
                     F.when(((k % 6).isin(4, 5) | (k % 10 == 2)) & ~silent, k).alias("raw_index"), F.when(k % 4 == 0, "by hand").alias("note"))
    gone = F.struct(F.when(k % 2 == 0, sha).alias("candidate_rle_sha1"), cid.alias("candidate_id"), F.lit(None).cast("long").alias("raw_index"), F.lit(None).cast("string").alias("note"))
    lists = t.pred.groupBy("image_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(w, F.struct("inst_id", e.alias("e"))))), lambda s: s["e"]).alias(n)
                                             for n, w, e in (("force_keep", k % 4 != 3, entry), ("force_drop", k % 5 < 2, gone))])
    inject = F.when(image % 4 == 0, F.array(*[F.struct(F.lit(f"h{j}").alias("candidate_rle_sha1"), F.lit(p).alias("path")) for j, p in ((3, "outside.json"), (4, "outside.json"), (6, "gone.json"), (3, "gone.json"))]))
    rows = lists.withColumn("inject_from_json", inject)
    inst, runs = _numbered(t)
    post = t.sats.select("image_id", k.alias("position"), "area", "cx", "cy", sha.alias("candidate_rle_sha1"), cid.alias("candidate_id"))
    return migrate_overrides(rows, predictions, masks.select("doc", "pred_id", "y", "x0", "x1"), post, inst.drop("old"), runs, audit_log(t), dry_run, stream_label="tidal_features")


_OVERRIDES = {**_START, "drawn": _MASK_BITS,
              "keys": "SELECT image_id, inst_id, type_label, 'h' || (inst_id % 40) AS sha, 'c' || (inst_id % 7) AS cid, image_id * 10000000 + inst_id AS pred_id FROM pred",
              "docs": """
    SELECT 'raw:' || image_id AS doc, * FROM keys
    UNION ALL SELECT 'outside.json', * FROM (SELECT * FROM keys WHERE image_id % 4 = 0 AND inst_id % 40 IN (1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY inst_id % 40 ORDER BY pred_id) = 1)""",
              "keeps": """
    SELECT *, CASE WHEN image_id % 4 = 0 AND sha IN ('h3', 'h4') THEN 'outside.json' WHEN image_id % 4 = 0 AND sha = 'h6' THEN 'gone.json' ELSE 'raw:' || image_id END AS doc FROM (
      SELECT image_id, inst_id, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) - 1 AS pos, CASE WHEN inst_id % 4 = 0 THEN 'by hand' END AS note,
        CASE WHEN inst_id % 6 IN (0, 3) AND inst_id % 14 <> 0 THEN 'h' || (inst_id % 40) END AS sha,
        CASE WHEN (inst_id % 6 IN (1, 2) OR inst_id % 12 = 0) AND inst_id % 14 <> 0 THEN 'c' || (inst_id % 7) END AS cid,
        CASE WHEN (inst_id % 6 IN (4, 5) OR inst_id % 10 = 2) AND inst_id % 14 <> 0 THEN inst_id END AS raw_index FROM pred WHERE inst_id % 4 <> 3)""",
              "kept_hits": """
    SELECT k.image_id, k.pos, count(d.doc) AS n, min(d.pred_id) AS pred_id FROM keeps k JOIN docs d ON d.doc = k.doc AND (k.sha IS NULL OR k.sha = d.sha) AND (k.cid IS NULL OR k.cid = d.cid) AND (k.raw_index IS NULL OR k.raw_index = d.inst_id)
    WHERE coalesce(k.sha, k.cid, k.raw_index::VARCHAR) IS NOT NULL GROUP BY ALL""",
              "selected": """
    SELECT k.*, h.pred_id, CASE WHEN k.doc = 'gone.json' THEN 'source_missing' WHEN sha IS NULL AND cid IS NULL AND raw_index IS NULL THEN 'no_selector' WHEN n IS NULL THEN 'no_match' WHEN n > 1 THEN 'ambiguous' END AS problem
    FROM keeps k LEFT JOIN kept_hits h USING (image_id, pos)""",
              **_adopting("""
    SELECT s.image_id, s.pos AS request_id, row_number() OVER (PARTITION BY s.image_id ORDER BY s.pos) AS rn, d.type_label, concat_ws(':', s.doc, d.cid, d.sha) AS source, false AS had,
      'authoritative' AS mode, px, bits, note FROM selected s JOIN docs d ON d.doc = s.doc AND d.pred_id = s.pred_id JOIN drawn w ON w.image_id = d.image_id AND w.inst_id = d.inst_id WHERE problem IS NULL""", 30),
              "places": """
    SELECT p.image_id, 'h' || (inst_id % 40) AS sha, 'c' || (inst_id % 7) AS cid, coalesce(s.top, 0) + row_number() OVER (PARTITION BY p.image_id ORDER BY area DESC, cx, cy, inst_id) AS place
    FROM pred_m p LEFT JOIN (SELECT image_id, max(nr) AS top FROM numbered WHERE type_label = 'tidal_features' GROUP BY ALL) s USING (image_id) WHERE type_label = 'satellites'""",
              "drops": """
    SELECT *, coalesce((SELECT max(place) FROM places p WHERE p.image_id = e.image_id AND p.sha = e.sha), (SELECT max(place) FROM places p WHERE p.image_id = e.image_id AND p.cid = e.cid)) AS inst_id FROM (
      SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) - 1 AS pos, CASE WHEN inst_id % 2 = 0 THEN 'h' || (inst_id % 40) END AS sha, 'c' || (inst_id % 7) AS cid FROM pred WHERE inst_id % 5 < 2) e""",
              "present": """
    SELECT image_id, nr AS inst_id, type_label FROM numbered UNION ALL SELECT image_id, inst_id, 'satellites' FROM boxed WHERE outcome = 'adopted'""",
              "erased": "SELECT DISTINCT image_id, d AS inst_id FROM log WHERE status = 'committed' AND d IS NOT NULL",
              "tried": """
    SELECT d.image_id, pos, d.inst_id, CASE WHEN d.inst_id IS NULL THEN 'unresolved' WHEN p.type_label IS NULL THEN CASE WHEN e.inst_id IS NOT NULL THEN 'already_deleted' ELSE 'missing' END
        WHEN p.type_label <> 'satellites' THEN 'unsupported_type' WHEN row_number() OVER (PARTITION BY d.image_id, d.inst_id ORDER BY pos) > 1 THEN 'already_deleted' END AS error
    FROM drops d LEFT JOIN present p USING (image_id, inst_id) LEFT JOIN erased e USING (image_id, inst_id)""",
              "outcomes": """
    SELECT s.image_id, 'force_keep' AS rule, s.pos, coalesce(problem, CASE WHEN outcome <> 'adopted' THEN outcome END) AS error, b.inst_id FROM selected s LEFT JOIN boxed b ON b.image_id = s.image_id AND b.request_id = s.pos
    UNION ALL SELECT image_id, 'force_drop', pos, error, inst_id FROM tried"""}


@query("r21_migrated_entries", "SELECT image_id, rule, pos::INT AS pos, error, inst_id FROM outcomes", ctes=_OVERRIDES)
def _(t):
    return _overrides(t).outcomes


@query("r21_migrated_state", """
    SELECT image_id, inst_id, type_label FROM present WHERE (image_id, inst_id) NOT IN (SELECT image_id, inst_id FROM tried WHERE error IS NULL)""", ctes=_OVERRIDES)
def _(t):
    return _overrides(t).instances.select("image_id", "inst_id", "type_label")


@query("r21_migrated_summary", "SELECT rule, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, 0::BIGINT AS skipped_dry_run FROM outcomes GROUP BY ALL", ctes=_OVERRIDES)
def _(t):
    return V.override_summary(_overrides(t).outcomes)


@query("r21_dry_run", """
    SELECT rule, 0::BIGINT AS ok, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT bad) AS skipped_dry_run FROM (
      SELECT 'force_keep' AS rule, doc = 'gone.json' AS bad FROM keeps UNION ALL SELECT 'force_drop', inst_id IS NULL FROM drops) GROUP BY ALL""", ctes=_OVERRIDES)
def _(t):
    return V.override_summary(_overrides(t, dry_run=True).outcomes, dry_run=True)
