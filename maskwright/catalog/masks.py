"""Named queries: mask algebra and shape figures."""

from pyspark.sql import functions as F

from maskwright.catalog import query
from maskwright.operators import match, runs as R, shape, tiles as B
from maskwright.plans.fixtures import SIDE


@query("m4_split_instances", """
    SELECT image_id, inst_id, count(*) AS area FROM gt_px GROUP BY ALL HAVING count(*) >= 100""")
def _(t):
    return R.split_instances(t.gt_runs, 100)


@query("m5_area", "SELECT image_id, inst_id, count(*) AS area FROM pred_px GROUP BY ALL")
def _(t):
    return R.areas(t.pred_runs)


@query("m6_bbox", """
    SELECT b.image_id, b.inst_id, coalesce(min(x), 0)::DOUBLE AS bbox_x, coalesce(min(y), 0)::DOUBLE AS bbox_y,
           coalesce(max(x) - min(x) + 1, 0)::DOUBLE AS bbox_w, coalesce(max(y) - min(y) + 1, 0)::DOUBLE AS bbox_h
    FROM boxes b LEFT JOIN pred_px p USING (image_id, inst_id) GROUP BY ALL""")
def _(t):
    return R.bboxes(t.pred_runs, all_masks=t.boxes)


@query("m7_mask_union", """
    SELECT image_id, y, count(DISTINCT x) AS px FROM pred_px GROUP BY ALL""")
def _(t):
    u = B.tile_rows(t.pred_runs, ["image_id"])
    return u.groupBy("image_id", F.col("y").cast("long").alias("y")).agg(F.sum(B.pixels(F.col("bits"))).alias("px"))


@query("m7_merged_runs", """
    SELECT image_id, y::BIGINT AS y, min(x)::BIGINT AS x0, max(x)::BIGINT + 1 AS x1 FROM (
      SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS i
      FROM (SELECT DISTINCT image_id, y, x FROM gt_px)) GROUP BY image_id, y, i""")
def _(t):
    m = R.merge_tiles(R.union_runs(t.gt_runs).drop("tile"), ["image_id"])
    return m.selectExpr("image_id", "cast(y as bigint) y", "cast(x0 as bigint) x0", "cast(x1 as bigint) x1")


# Nearest resize of the frame 256 -> 100: target j reads source floor(j * 2.56).
_RESAMPLED = {"small_px": """
    SELECT g.image_id, g.inst_id, jy.j AS y, jx.j AS x FROM gt_px g
    JOIN (SELECT j, floor(j * 256 / 100)::BIGINT AS s FROM (SELECT unnest(range(100)) AS j)) jy ON jy.s = g.y
    JOIN (SELECT j, floor(j * 256 / 100)::BIGINT AS s FROM (SELECT unnest(range(100)) AS j)) jx ON jx.s = g.x"""}


@query("m8_nearest_resample", """
    SELECT image_id, inst_id, count(*) AS area, min(y)::BIGINT AS y_min, max(y)::BIGINT AS y_max,
           min(x)::BIGINT AS x_min, max(x)::BIGINT AS x_max FROM small_px GROUP BY ALL""", ctes=_RESAMPLED)
def _(t):
    s = R.resample_runs(t.gt_runs, SIDE, 100)
    return s.groupBy("image_id", "inst_id").agg(
        F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area"), F.min("y").cast("long").alias("y_min"),
        F.max("y").cast("long").alias("y_max"), F.min("x0").cast("long").alias("x_min"),
        (F.max("x1") - 1).cast("long").alias("x_max"))


_TINY = {"tiny": """
    SELECT DISTINCT g.image_id, g.inst_id FROM gt_px g
    WHERE g.y % 16 = 0 AND g.x % 16 = 0"""}


@query("m9_lost_ids", """
    SELECT DISTINCT image_id, inst_id FROM gt_px EXCEPT SELECT image_id, inst_id FROM tiny""", ctes=_TINY)
def _(t):
    return R.lost_ids(t.gt_runs, R.resample_runs(t.gt_runs, SIDE, SIDE // 16))


@query("m10_paint_last_wins", """
    SELECT image_id, inst_id, count(*) AS visible_px FROM (
      SELECT image_id, y, x, max(inst_id) AS inst_id FROM gt_px GROUP BY ALL) GROUP BY ALL""")
def _(t):
    painted = R.paint(t.gt_runs, F.col("inst_id"))
    return painted.groupBy("image_id", "inst_id").agg(F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("visible_px"))


_STREAM_FIRST = {"won": """
    SELECT image_id, y, x, coalesce(max(inst_id) FILTER (type_label = 'tidal_features'), min(inst_id)) AS inst_id
    FROM pred_px GROUP BY ALL"""}


@query("m10_paint_stream_first", """
    SELECT p.image_id, p.inst_id, p.type_label, coalesce(w.visible_px, 0) AS visible_px,
           row_number() OVER (PARTITION BY p.image_id ORDER BY p.type_label DESC, p.inst_id) AS label_id
    FROM pred p LEFT JOIN (SELECT image_id, inst_id, count(*) AS visible_px FROM won GROUP BY ALL) w USING (image_id, inst_id)
    WHERE p.type_label = 'tidal_features' OR w.visible_px > 0""", ctes=_STREAM_FIRST)
def _(t):
    from maskwright.operators.layers import paint_stream_first

    return paint_stream_first(t.pred_runs, stream_label="tidal_features")[1]


@query("m11_merge_instances", """
    SELECT image_id, count(DISTINCT inst_id) AS n_inferred, sum(n)::BIGINT AS inferred_px, sum(o)::BIGINT AS overlap_px,
           sum(o)::DOUBLE / sum(n) AS overlap_rate, sum(k)::BIGINT AS written_px FROM (
      SELECT p.image_id, p.inst_id, count(*) AS n, count(s.y) AS o, 0 AS k
      FROM (SELECT * FROM pred_px WHERE type_label = 'satellites') p
      LEFT JOIN (SELECT DISTINCT image_id, y, x FROM gt_px WHERE type_label = 'tidal_features') s USING (image_id, y, x)
      GROUP BY ALL
      UNION ALL
      SELECT image_id, NULL, 0, 0, count(*) FROM (
        SELECT DISTINCT image_id, y, x FROM pred_px WHERE type_label = 'satellites'
        EXCEPT SELECT image_id, y, x FROM gt_px WHERE type_label = 'tidal_features') GROUP BY ALL) GROUP BY ALL""",
    doubles="overlap_rate")
def _(t):
    from maskwright.operators.layers import merge_with_streams

    return merge_with_streams(t.gt_of("tidal_features"), t.pred_of("satellites"))[1]


@query("m12_local_ids", """
    SELECT image_id, inst_id AS source_instance_id, dense_rank() OVER (PARTITION BY image_id ORDER BY inst_id) AS local_id FROM gt""")
def _(t):
    from maskwright.operators.layers import local_ids

    return local_ids(t.gt_runs)


@query("m13_per_class_ids", """
    SELECT image_id, inst_id, type_label, row_number() OVER w AS local_id,
           (CASE type_label WHEN 'tidal_features' THEN 1 WHEN 'satellites' THEN 2 ELSE 3 END) * 100000
             + row_number() OVER w AS global_id
    FROM pred WINDOW w AS (PARTITION BY image_id, type_label ORDER BY inst_id)""")
def _(t):
    from maskwright.operators.layers import per_class_ids

    return per_class_ids(t.pred.select("image_id", "inst_id", "type_label"))


@query("m14_id_map", """
    SELECT image_id, type_label, count(*) AS n, string_agg(k || '=' || inst_id, ',' ORDER BY inst_id) AS id_map FROM (
      SELECT image_id, type_label, inst_id, CASE WHEN type_label = 'tidal_features' THEN inst_id
             ELSE row_number() OVER (PARTITION BY image_id, type_label ORDER BY inst_id) - 1 END AS k FROM gt) GROUP BY ALL""")
def _(t):
    from maskwright.operators.layers import id_map

    m = id_map(t.gt.select("image_id", "inst_id", "type_label"), stream_label="tidal_features")
    return m.select("image_id", "type_label", F.size("id_map").cast("long").alias("n"), F.expr(
        "array_join(transform(array_sort(transform(map_entries(id_map), e -> struct(e.value, e.key))), "
        "e -> concat(e.key, '=', e.value)), ',')").alias("id_map"))


@query("m16_pixel_overlap", """
    SELECT a.image_id, a.inst_id AS id_a, b.inst_id AS id_b, count(*) AS inter
    FROM gt_px a JOIN gt_px b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x AND a.inst_id < b.inst_id GROUP BY ALL""")
def _(t):
    return match.self_overlaps(t.gt_runs)


@query("m19_boundary_inner", """
    SELECT p.image_id, p.inst_id, count(*) AS boundary_px FROM pred_px p
    WHERE NOT (EXISTS (SELECT 1 FROM pred_px q WHERE q.image_id = p.image_id AND q.inst_id = p.inst_id AND q.y = p.y AND q.x = p.x - 1)
       AND EXISTS (SELECT 1 FROM pred_px q WHERE q.image_id = p.image_id AND q.inst_id = p.inst_id AND q.y = p.y AND q.x = p.x + 1)
       AND EXISTS (SELECT 1 FROM pred_px q WHERE q.image_id = p.image_id AND q.inst_id = p.inst_id AND q.y = p.y - 1 AND q.x = p.x)
       AND EXISTS (SELECT 1 FROM pred_px q WHERE q.image_id = p.image_id AND q.inst_id = p.inst_id AND q.y = p.y + 1 AND q.x = p.x))
    GROUP BY ALL""")
def _(t):
    return B.bit_areas(B.inner_boundary(B.tile_rows(t.pred_runs)), name="boundary_px")


# Dilated: any neighbour within 2 set. Eroded: every neighbour within 2 inside the frame set.
_BAND = {"band": """
    SELECT image_id, inst_id, cy AS y, cx AS x, count(*) AS n,
           (least(cy + 2, 255) - greatest(cy - 2, 0) + 1) * (least(cx + 2, 255) - greatest(cx - 2, 0) + 1) AS need
    FROM (SELECT image_id, inst_id, y + dy AS cy, unnest([x - 2, x - 1, x, x + 1, x + 2]) AS cx
          FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS dy FROM gt_px))
    WHERE cy BETWEEN 0 AND 255 AND cx BETWEEN 0 AND 255 GROUP BY ALL"""}


@query("m20_boundary_band", """
    SELECT image_id, inst_id, count(*) FILTER (n < need) AS band_px FROM band GROUP BY ALL""", ctes=_BAND)
def _(t):
    return R.areas(R.boundary_band(t.gt_runs, SIDE, SIDE)).withColumnRenamed("area", "band_px")


@query("m22_crop_window", """
    SELECT p.image_id, p.inst_id, count(*) AS px, min(p.y - (CAST(floor(m.cy) AS BIGINT) - 6))::BIGINT AS y_min,
           min(p.x - (CAST(floor(m.cx) AS BIGINT) - 6))::BIGINT AS x_min
    FROM pred_px p JOIN pred_m m USING (image_id, inst_id)
    WHERE p.y >= floor(m.cy) - 6 AND p.y < floor(m.cy) + 6 AND p.x >= floor(m.cx) - 6 AND p.x < floor(m.cx) + 6
    GROUP BY ALL""")
def _(t):
    win = t.pred_m.select("image_id", "inst_id", F.floor("cx").cast("int").alias("center_x"),
                          F.floor("cy").cast("int").alias("center_y"), F.lit(12).alias("size"))
    c = R.crop_window(t.pred_runs, win)
    return c.groupBy("image_id", "inst_id").agg(
        F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("px"), F.min("y").cast("long").alias("y_min"),
        F.min("x0").cast("long").alias("x_min"))


@query("m23_window_fraction", """
    SELECT image_id, inst_id, count(*) FILTER (i) AS inside_px, count(*) FILTER (NOT i) AS outside_px,
           (count(*) FILTER (i))::DOUBLE / count(*) AS inside_frac, (count(*) FILTER (NOT i))::DOUBLE / count(*) AS outside_frac,
           bool_and(i) AS fully_inside
    FROM (SELECT *, y >= 32 AND y < 224 AND x >= 32 AND x < 224 AS i FROM pred_px) GROUP BY ALL""",
    doubles="inside_frac outside_frac")
def _(t):
    return R.window_fraction(t.pred_runs, (32, 32, 224, 224))


@query("m24_trim", """
    SELECT p.image_id, p.inst_id, count(*) AS left_px FROM (SELECT * FROM pred_px WHERE type_label = 'satellites') p
    ANTI JOIN (SELECT * FROM pred_px WHERE type_label = 'tidal_features') s USING (image_id, y, x) GROUP BY ALL""")
def _(t):
    left = B.without(B.tile_rows(t.pred_of("satellites")), B.tile_rows(t.pred_of("tidal_features"), ["image_id"]))
    return B.bit_areas(left, name="left_px")


@query("m24_trimmed_runs", """
    SELECT image_id, inst_id, y::BIGINT AS y, min(x)::BIGINT AS x0, max(x)::BIGINT + 1 AS x1 FROM (
      SELECT p.image_id, p.inst_id, p.y, p.x, x - row_number() OVER (PARTITION BY p.image_id, p.inst_id, p.y ORDER BY p.x) AS i, p.x // 64 AS tile FROM (SELECT * FROM pred_px WHERE type_label = 'satellites') p
      ANTI JOIN (SELECT * FROM pred_px WHERE type_label = 'tidal_features') s USING (image_id, y, x)) GROUP BY image_id, inst_id, y, i, tile""")
def _(t):
    """The trimmed masks themselves, as runs cut at tile borders."""
    left = B.without(B.tile_rows(t.pred_of("satellites")), B.tile_rows(t.pred_of("tidal_features"), ["image_id"]))
    return B.runs_of(left).selectExpr("image_id", "inst_id", "cast(y as bigint) y", "cast(x0 as bigint) x0", "cast(x1 as bigint) x1")


@query("g1_clean_mask", """
    SELECT image_id, inst_id, count(*) AS area_clean FROM pred_px GROUP BY ALL""")
def _(t):
    return R.areas(shape.clean_runs(t.pred_runs)).withColumnRenamed("area", "area_clean")


# Union of each image as one mask of many parts: exercises components and holes.
@query("g1_clean_union")
def _(t):
    u = B.runs_of(B.tile_rows(t.pred_runs, ["image_id"]), ["image_id"])
    return R.areas(shape.clean_runs(u.withColumn("inst_id", F.lit(1).cast("long")))).withColumnRenamed("area", "area_clean")


_MOMENT = {"mom": """
    SELECT image_id, inst_id, count(*) AS n, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb,
           sum(x)::DOUBLE / count(*) AS cx, sum(y)::DOUBLE / count(*) AS cy,
           var_samp(x::DOUBLE) AS vx, var_samp(y::DOUBLE) AS vy, covar_samp(x::DOUBLE, y::DOUBLE) AS c
    FROM pred_px GROUP BY ALL""",
    "eig": "SELECT *, (vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + c * c) AS e1, (vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + c * c) AS e0 FROM mom"}


@query("g2_mask_metrics", """
    SELECT image_id, inst_id, n AS area_raw, n AS area_clean, (xb - xa + 1)::BIGINT AS bbox_w, (yb - ya + 1)::BIGINT AS bbox_h,
           round_even(round(cx * 100, 6), 0) / 100 AS centroid_x, round_even(round(cy * 100, 6), 0) / 100 AS centroid_y,
           round_even(round(sqrt((cx - 128) ** 2 + (cy - 128) ** 2) * 100, 6), 0) / 100 AS dist_to_center,
           round_even(round(sqrt(e1 / greatest(e0, 1e-12)) * 10000, 6), 0) / 10000 AS aspect_sym_moment
    FROM eig""", ctes=_MOMENT)
def _(t):
    return shape.mask_metrics(t.pred_runs, SIDE, SIDE).drop("solidity")


@query("g3_aspect_moment", """
    SELECT image_id, inst_id, sqrt(e1 / greatest(e0, 1e-12)) AS aspect_sym_moment FROM eig""",
    doubles="aspect_sym_moment", ctes=_MOMENT)
def _(t):
    return shape.aspect_moment(shape.moments(t.pred_runs)).select("image_id", "inst_id", "aspect_sym_moment")


@query("g4_convex_area")
def _(t):
    return shape.convex_area(t.pred_runs)


@query("g5_solidity")
def _(t):
    return shape.solidity(t.pred_runs)


@query("g6_curvature_ratio")
def _(t):
    return shape.curvature_ratio(t.pred_runs)


@query("g7_aspect_boundary")
def _(t):
    return shape.aspect_boundary(t.pred_runs)


@query("g8_perimeter", """
    SELECT m.image_id, m.inst_id, m.n AS area, (xb - xa + 1)::BIGINT AS bbox_w, (yb - ya + 1)::BIGINT AS bbox_h,
           (4 * m.n - 2 * coalesce(h.k, 0) - 2 * coalesce(v.k, 0))::DOUBLE AS perimeter,
           m.n::DOUBLE / ((xb - xa + 1) * (yb - ya + 1)) AS extent,
           4 * pi() * m.n / ((4 * m.n - 2 * coalesce(h.k, 0) - 2 * coalesce(v.k, 0))::DOUBLE ** 2) AS circularity
    FROM mom m
    LEFT JOIN (SELECT a.image_id, a.inst_id, count(*) AS k FROM pred_px a JOIN pred_px b ON a.image_id = b.image_id AND a.inst_id = b.inst_id AND a.y = b.y AND a.x = b.x - 1 GROUP BY ALL) h USING (image_id, inst_id)
    LEFT JOIN (SELECT a.image_id, a.inst_id, count(*) AS k FROM pred_px a JOIN pred_px b ON a.image_id = b.image_id AND a.inst_id = b.inst_id AND a.y = b.y - 1 AND a.x = b.x GROUP BY ALL) v USING (image_id, inst_id)""",
    doubles="extent circularity", ctes=_MOMENT)
def _(t):
    return shape.perimeter(t.pred_runs)


@query("g9_instance_stats")
def _(t):
    return shape.instance_stats(t.gt_runs, t.gt.select("image_id", "inst_id", "type_label"))


@query("g12_edge_touch", """
    SELECT image_id, inst_id, count(*) AS area, count(*) FILTER (y IN (0, 255) OR x IN (0, 255)) AS border_px,
           (count(*) FILTER (y IN (0, 255) OR x IN (0, 255)))::DOUBLE / count(*) AS edge_ratio
    FROM pred_px GROUP BY ALL""", doubles="edge_ratio")
def _(t):
    return shape.edge_touch_ratio(t.pred_runs, SIDE, SIDE)


@query("g13_bbox_fill", """
    SELECT image_id, inst_id, n AS area, n::DOUBLE / ((xb - xa + 1) * (yb - ya + 1)) AS bbox_fill,
           n < 0.9::DOUBLE * ((xb - xa + 1) * (yb - ya + 1)) AS sparse FROM mom""", doubles="bbox_fill", ctes=_MOMENT)
def _(t):
    b = shape.bbox_fill(t.pred_runs, minimum=0.9)
    return b.select("image_id", "inst_id", "area", "bbox_fill", F.col("manual_note").startswith("warning").alias("sparse"))
