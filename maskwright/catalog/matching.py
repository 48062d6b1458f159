"""Named queries: overlaps, matches and groups."""

from pyspark.sql import functions as F

from maskwright.catalog import query
from maskwright.functions.policies import StreamConflict
from maskwright.operators import match, runs as R
from maskwright.plans.fixtures import SIDE


@query("e1_overlap_pairs", """
    SELECT image_id, pred_id, gt_id, inter, pred_area, gt_area, union_px, iou FROM pairs""", doubles="iou")
def _(t):
    return match.overlap_pairs(t.pred_runs, t.gt_runs)


_UNIONS = {
    "up": "SELECT DISTINCT image_id, y, x FROM pred_px",
    "ug": "SELECT DISTINCT image_id, y, x FROM gt_px",
    "px_counts": """
        SELECT i.image_id, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn
        FROM images i
        LEFT JOIN (SELECT image_id, count(*) AS np FROM up GROUP BY ALL) USING (image_id)
        LEFT JOIN (SELECT image_id, count(*) AS ng FROM ug GROUP BY ALL) USING (image_id)
        LEFT JOIN (SELECT image_id, count(*) AS tp FROM up JOIN ug USING (image_id, y, x) GROUP BY ALL) USING (image_id)"""}


@query("e2_binary_iou", """
    SELECT image_id, tp + fp AS pred_px, tp + fn AS gt_px, tp AS inter, tp + fp + fn AS union_px,
           CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp + fn) END AS binary_iou FROM px_counts""",
    doubles="binary_iou", ctes={k: v.replace("pred_px", "(SELECT * FROM pred_px UNION ALL SELECT -1 - image_id, inst_id, type_label, y, x FROM pred_px WHERE image_id % 7 = 0)")
               .replace("FROM images i", "FROM (SELECT image_id FROM images UNION ALL SELECT -1 - image_id FROM images WHERE image_id % 7 = 0) i") for k, v in _UNIONS.items()})
def _(t):
    # Every seventh image comes a second time, under an id below zero and without ground truth: one-sided images.
    more = t.pred_runs.where("image_id % 7 = 0").withColumn("image_id", -1 - F.col("image_id"))
    images = t.images.union(t.images.where("image_id % 7 = 0").select((-1 - F.col("image_id")).alias("image_id")))
    return match.binary_iou(t.pred_runs.unionByName(more), t.gt_runs, images)


@query("e3_union_vs_instances", """
    SELECT g.image_id, g.inst_id AS gt_id, g.area AS gt_area, coalesce(u.n, 0) AS pred_px, coalesce(h.n, 0) AS inter,
           coalesce(h.n, 0)::DOUBLE / (coalesce(u.n, 0) + g.area - coalesce(h.n, 0)) AS iou
    FROM gt_m g LEFT JOIN (SELECT image_id, count(*) AS n FROM up GROUP BY ALL) u USING (image_id)
    LEFT JOIN (SELECT image_id, inst_id, count(*) AS n FROM gt_px JOIN up USING (image_id, y, x) GROUP BY ALL) h
      ON g.image_id = h.image_id AND g.inst_id = h.inst_id""", doubles="iou", ctes=_UNIONS)
def _(t):
    return match.union_vs_instances(t.pred_runs, t.gt_runs)


_INDEX = {"idx": "SELECT image_id, inst_id, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) - 1 AS pred_idx FROM pred",
          "best": """
    SELECT g.image_id, g.inst_id AS gt_id, g.area AS gt_area,
           CASE WHEN b.pred_idx IS NOT NULL THEN b.pred_idx WHEN n.image_id IS NOT NULL THEN 0 ELSE -1 END AS best_pred_idx,
           coalesce(b.iou, 0) AS best_iou, coalesce(b.iou, 0) >= 0.5::DOUBLE AS detected
    FROM gt_m g LEFT JOIN (
      SELECT p.*, i.pred_idx, row_number() OVER (PARTITION BY p.image_id, gt_id ORDER BY iou DESC, i.pred_idx) AS rn
      FROM pairs p JOIN idx i ON p.image_id = i.image_id AND p.pred_id = i.inst_id) b
      ON b.image_id = g.image_id AND b.gt_id = g.inst_id AND b.rn = 1
    LEFT JOIN (SELECT DISTINCT image_id FROM pred) n ON n.image_id = g.image_id"""}


def _best(t):
    from maskwright.operators.numbering import number_rows

    pairs = match.overlap_pairs(t.pred_runs, t.gt_runs)
    pred = number_rows(t.pred.select("image_id", "inst_id"), ["image_id"], [F.col("inst_id")], "pred_idx", start=0)
    gt = R.areas(t.gt_runs).withColumnRenamed("area", "gt_area")
    return match.best_match(pairs, gt, pred)


@query("e4_best_match", "SELECT * FROM best", doubles="best_iou", ctes=_INDEX)
def _(t):
    return _best(t)


@query("e4_best_match_recall", """
    SELECT i.image_id, count(b.gt_id) AS num_gt, count(b.gt_id) FILTER (detected) AS num_detected,
           coalesce((count(b.gt_id) FILTER (detected))::DOUBLE / nullif(count(b.gt_id), 0), 0) AS recall,
           coalesce(avg(best_iou) FILTER (detected), 0) AS matched_iou
    FROM images i LEFT JOIN best b USING (image_id) GROUP BY ALL""", doubles="recall matched_iou", ctes=_INDEX)
def _(t):
    return match.best_match_recall(_best(t), t.images)


def optimal_ctes(edges: str) -> dict[str, str]:
    """Optimal one-to-one pairs of ``edges`` (scope, image_id, pred_id, gt_id, iou): all choices of a component are tried."""
    return {"scoped_edges": edges, "weighed": "SELECT *, floor(iou * 1073741824)::BIGINT * 1048576 + (gt_id % 65521) * (pred_id % 65521) % 4093 AS w FROM scoped_edges",
            "both_ways": """
    SELECT scope, image_id, 2 * gt_id AS a, 2 * pred_id + 1 AS b FROM weighed UNION ALL SELECT scope, image_id, 2 * pred_id + 1, 2 * gt_id FROM weighed""",
            "reach": """
    SELECT DISTINCT scope, image_id, a AS x, a AS y FROM both_ways
    UNION SELECT r.scope, r.image_id, r.x, b.b FROM reach r JOIN both_ways b ON b.scope = r.scope AND b.image_id = r.image_id AND b.a = r.y""",
            "component": "SELECT scope, image_id, x, min(y) AS comp FROM reach GROUP BY ALL",
            "choices": """
    SELECT scope, image_id, comp, dense_rank() OVER (PARTITION BY scope, image_id, comp ORDER BY gt_id) AS k, gt_id, pred_id, w FROM (
      SELECT e.scope, e.image_id, comp, gt_id, pred_id, w FROM weighed e JOIN component c ON c.scope = e.scope AND c.image_id = e.image_id AND c.x = 2 * e.gt_id
      UNION ALL SELECT DISTINCT e.scope, e.image_id, comp, gt_id, NULL::BIGINT, 0::BIGINT FROM weighed e JOIN component c ON c.scope = e.scope AND c.image_id = e.image_id AND c.x = 2 * e.gt_id)""",
            "picks": """
    SELECT DISTINCT scope, image_id, comp, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS total, []::STRUCT(g BIGINT, p BIGINT)[] AS chosen FROM choices
    UNION ALL SELECT p.scope, p.image_id, p.comp, c.k, list_append(used, coalesce(c.pred_id, -1)), total + w, list_append(chosen, {'g': c.gt_id, 'p': c.pred_id})
    FROM picks p JOIN choices c ON c.scope = p.scope AND c.image_id = p.image_id AND c.comp = p.comp AND c.k = p.k + 1 AND (c.pred_id IS NULL OR NOT list_contains(p.used, c.pred_id))""",
            "optimal": """
    SELECT scope, image_id, c.g AS gt_id, c.p AS pred_id FROM (SELECT scope, image_id, unnest(chosen) AS c FROM (
      SELECT scope, image_id, comp, arg_max(chosen, total) AS chosen FROM (SELECT * FROM picks QUALIFY k = max(k) OVER (PARTITION BY scope, image_id, comp)) GROUP BY ALL)) WHERE c.p IS NOT NULL""",
            "per_gt": """
    SELECT g.scope, g.image_id, g.gt_id, g.gt_area, CASE WHEN e.iou >= 0.5::DOUBLE THEN e.pred_id END AS matched_pred_id, CASE WHEN e.iou >= 0.5::DOUBLE THEN e.iou END AS matched_iou,
      CASE WHEN e.iou >= 0.5::DOUBLE THEN NULL ELSE coalesce(b.best, 0) END AS unmatched_iou, coalesce(e.iou >= 0.5::DOUBLE, false) AS detected
    FROM scoped_gt g LEFT JOIN optimal o ON o.scope = g.scope AND o.image_id = g.image_id AND o.gt_id = g.gt_id
    LEFT JOIN scoped_edges e ON e.scope = o.scope AND e.image_id = o.image_id AND e.gt_id = o.gt_id AND e.pred_id = o.pred_id
    LEFT JOIN (SELECT scope, image_id, gt_id, max(iou) AS best FROM scoped_edges GROUP BY ALL) b ON b.scope = g.scope AND b.image_id = g.image_id AND b.gt_id = g.gt_id"""}


_PER_GT = "SELECT image_id, gt_id, gt_area, matched_pred_id, matched_iou, unmatched_iou, detected FROM per_gt"


@query("e5_optimal_match", _PER_GT, doubles="matched_iou unmatched_iou", ctes={
    **optimal_ctes("SELECT 'all' AS scope, image_id, pred_id, gt_id, iou FROM sat_pairs"),
    "scoped_gt": "SELECT 'all' AS scope, image_id, inst_id AS gt_id, area AS gt_area FROM gt_m WHERE type_label = 'satellites'"})
def _(t):
    pairs = match.overlap_pairs(t.pred_of("satellites"), t.gt_of("satellites"))
    gt = R.areas(t.gt_of("satellites")).withColumnRenamed("area", "gt_area")
    return match.optimal_match(pairs, match.optimal_pairs(pairs), gt)


@query("e6_optimal_match_rle", """
    SELECT * EXCLUDE (gt_id), row_number() OVER (PARTITION BY image_id ORDER BY gt_id) AS position FROM (""" + _PER_GT + ")", doubles="matched_iou unmatched_iou", ctes={
        **optimal_ctes("SELECT 'all' AS scope, image_id, pred_id, gt_id, iou FROM pairs"),
        "scoped_gt": "SELECT 'all' AS scope, image_id, inst_id AS gt_id, area AS gt_area FROM gt_m"})
def _(t):
    """Overlapping instances with 1-based positions instead of ids."""
    from maskwright.operators.numbering import number_rows

    pairs = match.overlap_pairs(t.pred_runs, t.gt_runs)
    gt = R.areas(t.gt_runs).withColumnRenamed("area", "gt_area")
    out = match.optimal_match(pairs, match.optimal_pairs(pairs), gt)
    return number_rows(out, ["image_id"], [F.col("gt_id")], "position").drop("gt_id")


@query("e7_primary_match", """
    SELECT image_id, inst_id AS pred_id, area, matched_gt_id, overlap_px, matched_gt_area FROM primary_m""")
def _(t):
    return match.primary_match(t.sat_pairs, t.sats.select("image_id", "inst_id", "area"))


@query("e8_one_to_one", "SELECT image_id, inst_id AS pred_id, matched_gt_id, is_one_to_one FROM one2one")
def _(t):
    m = match.primary_match(t.sat_pairs, t.sats.select("image_id", "inst_id", "area"))
    return match.one_to_one_flags(m, "pred_id").select("image_id", "pred_id", "matched_gt_id", "is_one_to_one")


_MATCHES = {"cand_match": """
    SELECT p.image_id, p.inst_id AS pred_id, p.score AS confidence_score, p.filter_status,
           b.gt_id AS best_gt_id, coalesce(b.iou, 0) AS best_iou, coalesce(s.iou, 0) AS second_best_iou,
           p.area::DOUBLE / b.gt_area AS area_ratio, coalesce(n.k, 0) >= 2 AS overlaps_multiple_gt
    FROM (SELECT * FROM pred_m WHERE type_label = 'satellites') p
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) AS rn FROM sat_pairs) b
      ON b.image_id = p.image_id AND b.pred_id = p.inst_id AND b.rn = 1
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) AS rn FROM sat_pairs) s
      ON s.image_id = p.image_id AND s.pred_id = p.inst_id AND s.rn = 2
    LEFT JOIN (SELECT image_id, pred_id, count(*) AS k FROM sat_pairs WHERE iou >= 0.05::DOUBLE GROUP BY ALL) n
      ON n.image_id = p.image_id AND n.pred_id = p.inst_id"""}


def candidate_matches(t, bands: bool = False):
    pred = t.sats.withColumn("confidence_score", F.coalesce("score", "stability_score", F.lit(0.0)))
    m = match.match_candidates(t.sat_pairs, pred)
    if not bands:
        return m
    best = m.where("best_gt_id is not null").select("image_id", "pred_id", F.col("best_gt_id").alias("gt_id"))
    f1 = match.boundary_f1(best, t.pred_of("satellites"), t.gt_of("satellites"), SIDE, SIDE)
    return match.match_candidates(t.sat_pairs, pred, f1)


@query("e9_match_candidates", "SELECT * FROM cand_match", doubles="best_iou second_best_iou area_ratio confidence_score", ctes=_MATCHES)
def _(t):
    return candidate_matches(t)


_BANDS = {
    "bands": """
      SELECT k, image_id, inst_id, y, x FROM (
        SELECT k, image_id, inst_id, cy AS y, cx AS x, count(*) AS n,
               (least(cy + 2, 255) - greatest(cy - 2, 0) + 1) * (least(cx + 2, 255) - greatest(cx - 2, 0) + 1) AS need
        FROM (SELECT k, image_id, inst_id, y + dy AS cy, unnest([x - 2, x - 1, x, x + 1, x + 2]) AS cx
              FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS dy FROM (
                SELECT 'p' AS k, image_id, inst_id, type_label, y, x FROM pred_px UNION ALL SELECT 'g', image_id, inst_id, type_label, y, x FROM gt_px)
                WHERE type_label = 'satellites'))
        WHERE cy BETWEEN 0 AND 255 AND cx BETWEEN 0 AND 255 GROUP BY ALL) WHERE n < need""",
    "band_f1": """
      SELECT m.image_id, m.pred_id, m.best_gt_id AS gt_id,
             CASE WHEN coalesce(tp, 0) = 0 THEN 0::DOUBLE ELSE 2 * (tp::DOUBLE / pa) * (tp::DOUBLE / ga) / (tp::DOUBLE / pa + tp::DOUBLE / ga) END AS boundary_f1
      FROM (SELECT * FROM cand_match WHERE best_gt_id IS NOT NULL) m
      LEFT JOIN (SELECT c.image_id, c.pred_id, c.best_gt_id, count(*) AS tp FROM cand_match c
                 JOIN bands p ON p.k = 'p' AND p.image_id = c.image_id AND p.inst_id = c.pred_id
                 JOIN bands g ON g.k = 'g' AND g.image_id = c.image_id AND g.inst_id = c.best_gt_id AND g.y = p.y AND g.x = p.x GROUP BY ALL) h
        USING (image_id, pred_id, best_gt_id)
      JOIN (SELECT image_id, inst_id AS pred_id, count(*) AS pa FROM bands WHERE k = 'p' GROUP BY ALL) USING (image_id, pred_id)
      JOIN (SELECT image_id, inst_id AS best_gt_id, count(*) AS ga FROM bands WHERE k = 'g' GROUP BY ALL) USING (image_id, best_gt_id)"""}


@query("m21_boundary_f1", "SELECT * FROM band_f1", doubles="boundary_f1", ctes={**_MATCHES, **_BANDS})
def _(t):
    best = candidate_matches(t).where("best_gt_id is not null").select("image_id", "pred_id", F.col("best_gt_id").alias("gt_id"))
    return match.boundary_f1(best, t.pred_of("satellites"), t.gt_of("satellites"), SIDE, SIDE)


_EXH = {"exh": """
    SELECT i.image_id, coalesce(g.n, 0) AS num_gt, coalesce(c.m, 0) AS num_pred_matched,
           coalesce(g.n, 0) - coalesce(c.h, 0) AS num_gt_unmatched, coalesce(c.n, 0) - coalesce(c.m, 0) AS num_pred_unmatched,
           coalesce(c.mean_iou, 0) AS mean_matched_iou,
           coalesce(c.h::DOUBLE / g.n, CASE WHEN g.n > 0 THEN 0 ELSE 1 END) >= 0.9::DOUBLE AND coalesce(c.m::DOUBLE / c.n, 1) >= 0.9::DOUBLE AS exhaustivity_confident,
           coalesce(a.tg, 0) AS total_gt_area, coalesce(b.tp, 0) AS total_pred_area, coalesce(d.ug, 0) AS unmatched_gt_area, coalesce(e.up, 0) AS unmatched_pred_area,
           coalesce(c.h::DOUBLE / g.n, CASE WHEN g.n > 0 THEN 0 ELSE 1 END) AS recall, coalesce(c.m::DOUBLE / c.n, 1) AS precision
    FROM images i
    LEFT JOIN (SELECT image_id, count(*) AS n FROM gt WHERE type_label = 'satellites' GROUP BY ALL) g USING (image_id)
    LEFT JOIN (SELECT image_id, count(*) AS n, count(*) FILTER (best_iou >= 0.3::DOUBLE) AS m, avg(best_iou) FILTER (best_iou >= 0.3::DOUBLE) AS mean_iou,
                      count(DISTINCT best_gt_id) FILTER (best_iou >= 0.3::DOUBLE) AS h FROM cand_match GROUP BY ALL) c USING (image_id)
    LEFT JOIN (SELECT image_id, count(DISTINCT (y, x)) AS tg FROM gt_px WHERE type_label = 'satellites' GROUP BY ALL) a USING (image_id)
    LEFT JOIN (SELECT image_id, count(DISTINCT (y, x)) AS tp FROM pred_px WHERE type_label = 'satellites' GROUP BY ALL) b USING (image_id)
    LEFT JOIN (SELECT p.image_id, count(DISTINCT (y, x)) AS ug FROM gt_px p ANTI JOIN (SELECT * FROM cand_match WHERE best_iou >= 0.3::DOUBLE) m
               ON m.image_id = p.image_id AND m.best_gt_id = p.inst_id WHERE type_label = 'satellites' GROUP BY ALL) d USING (image_id)
    LEFT JOIN (SELECT p.image_id, count(DISTINCT (y, x)) AS up FROM pred_px p JOIN (SELECT * FROM cand_match WHERE best_iou < 0.3::DOUBLE) m
               ON m.image_id = p.image_id AND m.pred_id = p.inst_id GROUP BY ALL) e USING (image_id)"""}


def coverage(t):
    return match.exhaustivity(candidate_matches(t), t.pred_of("satellites"), t.gt_of("satellites"), t.images)


@query("e10_exhaustivity", "SELECT * FROM exh", doubles="mean_matched_iou recall precision", ctes={**_MATCHES, **_EXH})
def _(t):
    return coverage(t)


def centroid_cents(name: str):
    """Two decimals as the SQL rounds them, on the scaled double: F.round takes the decimal text and differs at ties."""
    return F.round(F.col(name) * 100) / 100


@query("e11_centroid_groups", """
    SELECT image_id, idx, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS group_id FROM (
      SELECT a.image_id, a.idx, min(r.b) AS root FROM pts a JOIN reach r ON r.image_id = a.image_id AND r.a = a.idx GROUP BY ALL)""",
    ctes={"pts": "SELECT image_id, inst_id AS idx, round(cx, 2) AS cx, round(cy, 2) AS cy FROM pred_m WHERE type_label = 'satellites'",
          "near": """SELECT a.image_id, a.idx AS a, b.idx AS b FROM pts a JOIN pts b USING (image_id)
              WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 144""",
          # DuckDB takes the recursive keyword per WITH; a table function of repeated squaring is enough here.
          "r2": "SELECT DISTINCT x.image_id, x.a, y.b FROM near x JOIN near y ON x.image_id = y.image_id AND x.b = y.a",
          "r4": "SELECT DISTINCT x.image_id, x.a, y.b FROM r2 x JOIN r2 y ON x.image_id = y.image_id AND x.b = y.a",
          "r8": "SELECT DISTINCT x.image_id, x.a, y.b FROM r4 x JOIN r4 y ON x.image_id = y.image_id AND x.b = y.a",
          "reach": "SELECT DISTINCT x.image_id, x.a, y.b FROM r8 x JOIN r8 y ON x.image_id = y.image_id AND x.b = y.a"})
def _(t):
    pts = t.sats.select("image_id", F.col("inst_id").alias("idx"), centroid_cents("cx").alias("cx"), centroid_cents("cy").alias("cy"))
    return match.group_by_centroid(pts, dist=12.0).select("image_id", "idx", "group_id")


@query("e12_representatives", """
    SELECT image_id, idx, group_id, rep_score,
           CASE WHEN row_number() OVER (PARTITION BY image_id, group_id ORDER BY rep_score DESC, idx) > 1 THEN 'duplicate' END AS reject_reason
    FROM (SELECT image_id, inst_id AS idx, inst_id % 4 AS group_id,
             round(stability_score + score - 0.3::DOUBLE * abs(aspect_sym_moment - 1) - 0.2::DOUBLE * abs(ln(area) - ln(254::DOUBLE)), 9) AS rep_score
          FROM pred_m WHERE type_label = 'satellites')""", doubles="rep_score")
def _(t):
    m = t.sats.select("image_id", F.col("inst_id").alias("idx"), F.expr("inst_id % 4").alias("group_id"),
                      "stability_score", "score", "aspect_sym_moment", "area")
    r = match.representatives(m)
    return r.select("image_id", "idx", "group_id", "rep_score", "reject_reason")


_CONFLICT = {"conflict": """
    SELECT p.image_id, p.inst_id AS pred_id, p.score, p.area, p.solidity, p.aspect_sym_moment, b.gt_id AS matched_stream_id,
           coalesce(b.inter, 0) AS overlap_px, coalesce(b.inter, 0)::DOUBLE / p.area AS overlap_ratio_satellite,
           coalesce(b.inter::DOUBLE / b.gt_area, 0) AS overlap_ratio_stream,
           CASE WHEN b.gt_id IS NULL THEN 'pass'
                WHEN b.inter::DOUBLE / p.area >= 0.5::DOUBLE AND p.area >= 80 AND p.solidity >= 0.8::DOUBLE AND p.aspect_sym_moment <= 1.8::DOUBLE THEN 'win'
                ELSE 'drop' END AS decision,
           CASE WHEN b.gt_id IS NULL THEN 'pass_no_stream_conflict'
                WHEN b.inter::DOUBLE / p.area >= 0.5::DOUBLE AND p.area >= 80 AND p.solidity >= 0.8::DOUBLE AND p.aspect_sym_moment <= 1.8::DOUBLE THEN 'satellite_wins'
                WHEN p.area < 80 THEN 'area_under_600_swallowed_by_stream'
                WHEN NOT (p.solidity >= 0.8::DOUBLE AND p.aspect_sym_moment <= 1.8::DOUBLE) THEN 'not_compact_enough_to_win'
                ELSE 'lost_to_stream_area_ge_600' END AS reason
    FROM (SELECT * FROM pred_m WHERE type_label = 'satellites') p LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY inter DESC, gt_id) AS rn
      FROM pairs WHERE pred_type = 'satellites' AND gt_type = 'tidal_features') b
    ON b.image_id = p.image_id AND b.pred_id = p.inst_id AND b.rn = 1"""}
CONFLICT = StreamConflict(rescue_overlap_ratio_satellite=0.5, rescue_area_min_px=80, rescue_solidity_min=0.8)


def conflicts(t):
    pairs = match.overlap_pairs(t.pred_of("satellites"), t.gt_of("tidal_features"))
    sats = t.sats.select("image_id", "inst_id", "score", "area", "solidity", "aspect_sym_moment")
    return match.stream_conflicts(pairs, sats, CONFLICT)


@query("p8_gt_stream_conflict", "SELECT * FROM conflict",
       doubles="overlap_ratio_satellite overlap_ratio_stream", ctes=_CONFLICT)
def _(t):
    return conflicts(t)


@query("p14_post_gt_aware", "SELECT image_id, pred_id, decision FROM conflict WHERE decision <> 'drop'", ctes=_CONFLICT)
def _(t):
    return conflicts(t).where("decision <> 'drop'").select("image_id", "pred_id", "decision")


@query("e17_reconcile_ids", """
    SELECT coalesce(m.image_id, l.image_id) AS image_id, coalesce(m.inst_id, l.inst_id) AS inst_id,
           CASE WHEN l.inst_id IS NULL THEN 'map_only' WHEN m.inst_id IS NULL THEN 'listed_only' ELSE 'both' END AS found
    FROM (SELECT image_id, inst_id FROM gt) m FULL JOIN (SELECT image_id, inst_id FROM pred) l
      ON m.image_id = l.image_id AND m.inst_id = l.inst_id""")
def _(t):
    from maskwright.operators.layers import reconcile_ids

    return reconcile_ids(t.gt_runs, t.pred)


@query("e18_reject_candidates", """
    SELECT p.image_id, p.inst_id FROM pred_m p
    WHERE type_label = 'satellites' AND NOT (score >= 0.6::DOUBLE)
      AND NOT EXISTS (SELECT 1 FROM sat_pairs s WHERE s.image_id = p.image_id AND s.pred_id = p.inst_id AND s.iou > 0.3::DOUBLE)""")
def _(t):
    from maskwright.operators.review import reject_candidates

    raw = t.sats.select("image_id", "inst_id", F.col("inst_id").cast("string").alias("candidate_rle_sha1"))
    post = t.sats.where("score >= 0.6D").select("image_id", F.col("inst_id").cast("string").alias("candidate_rle_sha1"))
    return reject_candidates(raw, post, t.sat_pairs).select("image_id", "inst_id")
