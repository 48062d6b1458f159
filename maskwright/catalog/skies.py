"""Named queries: catalogues, regions, rasters and benchmark checks."""

from pyspark.sql import functions as F

from maskwright.catalog import query
from maskwright.operators import regions as G, runs as R, tiles as B, tradeoff
from maskwright.plans.fixtures import SIDE
from maskwright.sources import readers as S


@query("m15_mask_from_coords", """
    SELECT image_id, inst_id, count(DISTINCT (least(199, y), least(199, x))) AS area FROM gt_px GROUP BY ALL""")
def _(t):
    px = t.gt_runs.select("image_id", "inst_id", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))
    return R.areas(R.runs_of_pixels(px, ["image_id", "inst_id"], 200, 200))


def shapes(t):
    """Boxes as outlines: even ids polygons, odd ids open lines along two sides."""
    corner = "struct(double({x}) as x, double({y}) as y)"
    pts = ", ".join(corner.format(x=x, y=y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))
    line = ", ".join(corner.format(x=x, y=y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1")))
    kind = F.when(F.col("inst_id") % 2 == 0, "polygon").otherwise("line")
    names = F.array(*[F.lit(c) for c in ("Inner", "Halo", "Shells", "Stream", "Tail")])
    return t.gt.select("image_id", "inst_id", kind.alias("kind"), names[(F.col("inst_id") % 5).cast("int")].alias("type"),
                       F.expr(f"case when inst_id % 2 = 0 then array({pts}) else array({line}) end").alias("verts"))


_RASTER = {"ras": """
    SELECT image_id, inst_id, yy AS y, unnest(range(x0, least(x1, 255) + 1)) AS x FROM (SELECT *, unnest(range(y0, least(y1, 255) + 1)) AS yy FROM gt WHERE inst_id % 2 = 0)
    UNION ALL SELECT image_id, inst_id, y, x FROM (SELECT image_id, inst_id, y, unnest(range(greatest(x0 - 1, 0), least(x1 + 1, 255) + 1)) AS x FROM (
      SELECT *, unnest(range(greatest(y0 - 1, 0), least(y0 + 1, 255) + 1)) AS y FROM gt WHERE inst_id % 2 = 1))
    UNION SELECT image_id, inst_id, y, x FROM (SELECT image_id, inst_id, y, unnest(range(greatest(x1 - 1, 0), least(x1 + 1, 255) + 1)) AS x FROM (
      SELECT *, unnest(range(greatest(y0 - 1, 0), least(y1 + 1, 255) + 1)) AS y FROM gt WHERE inst_id % 2 = 1))""",
           "typed": "SELECT DISTINCT image_id, inst_id, y, x, ['Inner', 'Halo', 'Shells', 'Stream', 'Tail'][inst_id % 5 + 1] AS type FROM ras"}


@query("m17_rasterize_shapes", "SELECT image_id, inst_id, count(DISTINCT (y, x)) AS area FROM ras GROUP BY ALL", ctes=_RASTER)
def _(t):
    return B.bit_areas(G.raster_rows(shapes(t), SIDE, SIDE))


@query("m18_bind_classes", """
    SELECT image_id, count(*) AS px FROM (SELECT DISTINCT image_id, y, x FROM typed WHERE type <> 'Inner') GROUP BY ALL""", ctes=_RASTER)
def _(t):
    painted, _ = G.bind_classes(G.rasterize_shapes(shapes(t), SIDE, SIDE), shapes(t))
    return painted.groupBy("image_id").agg(F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("px"))


@query("d19_annotate_shapes", """
    SELECT row_number() OVER (ORDER BY image_id, inst_id) AS id, image_id, inst_id, (inst_id % 5)::BIGINT AS category_id, count(*) AS area, min(x)::DOUBLE AS bbox_x, min(y)::DOUBLE AS bbox_y,
           (max(x) - min(x) + 1)::DOUBLE AS bbox_w, (max(y) - min(y) + 1)::DOUBLE AS bbox_h FROM typed GROUP BY image_id, inst_id""", ctes=_RASTER)
def _(t):
    a = G.annotate_shapes(shapes(t), G.rasterize_shapes(shapes(t), SIDE, SIDE))
    return a.drop("type", "kind")


def _region_lines(t):
    """A region file per part: header and shape lines spelled from its line items."""
    names = F.array(*[F.lit(c) for c in ("Inner Galaxy", "Halo", "Shells", "Stream", "Cirrus")])
    head = F.format_string("# Feature%d NGC%d %s", F.col("inst_id"), F.col("image_id"), names[(F.col("inst_id") % 5).cast("int")])
    body = F.format_string("polygon(%d,%d,%d,%d,%d,%s)", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0"), F.col("x1"), F.when(F.col("inst_id") % 7 == 0, "bad").otherwise(F.col("y1").cast("string")))
    return t.gt.select(F.col("image_id").cast("string").alias("file"), F.explode(F.array(F.struct((F.col("inst_id") * 2).alias("n"), head.alias("v")), F.struct((F.col("inst_id") * 2 + 1).alias("n"), body.alias("v")))).alias("l")).select(
        "file", F.col("l.n").alias("line_no"), F.col("l.v").alias("value"))


_REG = {"reg": """
    SELECT 'NGC' || image_id AS galaxy, inst_id AS feature_id, ['Inner', 'Halo', 'Shells', 'Stream'][inst_id % 5 + 1] AS type, image_id, x0, x1, y0, y1 FROM gt WHERE inst_id % 5 <> 4 AND inst_id % 7 <> 0"""}


@query("s10_read_regions", "SELECT galaxy, feature_id, type, 'polygon' AS kind, 3::BIGINT AS n FROM reg", ctes=_REG)
def _(t):
    return S.parse_regions(_region_lines(t)).select("galaxy", "feature_id", "type", "kind", F.size("verts").cast("long").alias("n"))


@query("e19_assemble_galaxies", """
    SELECT 'NGC' || i.image_id AS galaxy, count(DISTINCT feature_id) AS n_shapes, min(x0)::DOUBLE AS ra_min, max(x1)::DOUBLE AS ra_max, min(y0)::DOUBLE AS dec_min, max(y1)::DOUBLE AS dec_max
    FROM images i LEFT JOIN reg USING (image_id) WHERE i.image_id % 3 <> 0 GROUP BY ALL""", ctes=_REG)
def _(t):
    table = t.images.select(F.concat(F.lit("NGC"), F.col("image_id").cast("string")).alias("galaxy"), F.when(F.col("image_id") % 3 == 0, "CFIS").otherwise("MATLAS").alias("survey"))
    return G.assemble_galaxies(table, S.parse_regions(_region_lines(t))).select("galaxy", "n_shapes", "ra_min", "ra_max", "dec_min", "dec_max")


@query("s19_galaxy_index", "SELECT 'NGC' || i.image_id AS galaxy, count(feature_id) AS n FROM images i LEFT JOIN reg USING (image_id) GROUP BY ALL", ctes=_REG)
def _(t):
    """Nested records written as JSON and read back."""
    g = t.images.select(F.concat(F.lit("NGC"), F.col("image_id").cast("string")).alias("galaxy"))
    rec = G.galaxy_index(g, S.parse_regions(_region_lines(t)))
    back = G.read_galaxy_index(rec, "galaxy string, shapes array<struct<feature_id bigint, type string>>")
    return back.select("galaxy", F.coalesce(F.size("shapes"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query("e20_radec_to_pixel", """
    SELECT image_id, inst_id, round((-xi) / 0.0005::DOUBLE + 128.0, 4) AS px, round(eta / 0.0005::DOUBLE + 128.0, 4) AS py FROM (
      SELECT *, degrees(cos(d) * sin(r - r0) / c) AS xi, degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(r - r0)) / c) AS eta FROM (
        SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(r - r0) AS c FROM (
          SELECT image_id, inst_id, radians(150 + x0 / 1000.0::DOUBLE) AS r, radians(2 + y0 / 1000.0::DOUBLE) AS d, radians(150.1::DOUBLE) AS r0, radians(2.1::DOUBLE) AS d0 FROM gt)))""", doubles="px py")
def _(t):
    cols = {"crval1": 150.1, "crval2": 2.1, "crpix1": 129.0, "crpix2": 129.0, "cd11": -0.0005, "cd12": 0.0, "cd21": 0.0, "cd22": 0.0005}
    p = t.gt.select("image_id", "inst_id", F.expr("150 + x0 / double(1000)").alias("ra"), F.expr("2 + y0 / double(1000)").alias("dec"), *[F.lit(v).alias(k) for k, v in cols.items()])
    return G.radec_to_pixel(p).select("image_id", "inst_id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


def _nested(t):
    """Catalogue nested by galaxy view, limit and object id."""
    obj = t.gt_m.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("inst_id").cast("string"), F.struct("area", "cx", "cy")))).alias("objects"))
    return obj.select(F.concat(F.col("image_id").cast("string"), F.lit(", eo")).alias("galaxy_key"), F.create_map(F.lit("SBlim27.5"), F.col("objects")).alias("limits"))


@query("s9_flatten_catalogue", "SELECT image_id::INTEGER AS galaxy_id, 'eo' AS view_id, 27.5::DOUBLE AS sb_limit, inst_id::INTEGER AS sat_id, area FROM gt_m")
def _(t):
    return S.flatten_catalogue(_nested(t)).select("galaxy_id", "view_id", "sb_limit", "sat_id", "area")


def _bench(t):
    cat = t.gt_m.where("type_label = 'satellites'").select(F.col("image_id").alias("sample_id"), F.col("inst_id").alias("sat_id"), "area", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return G.benchmark_instances(cat, t.images.select(F.col("image_id").alias("sample_id"), F.expr("image_id % 500").alias("galaxy_id")))


@query("d15_benchmark_instances", """
    SELECT image_id AS sample_id, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) AS id, 'id' || inst_id AS source_object_id, area::DOUBLE AS area FROM gt_m WHERE type_label = 'satellites'""")
def _(t):
    return _bench(t)[0].select("sample_id", "id", "source_object_id", "area")


@query("a32_benchmark_errors", """
    SELECT image_id AS sample_id, e AS error FROM (SELECT image_id, count(*) AS n FROM gt WHERE type_label = 'satellites' GROUP BY ALL), (SELECT unnest(['max_id_differs', 'ids_not_contiguous']) AS e) WHERE image_id % 10 = 0
    UNION ALL SELECT NULL, 'total_samples'""")
def _(t):
    """The last label of every tenth sample is missing from its map, and one total is off."""
    inst, samples = _bench(t)
    top = inst.groupBy("sample_id").agg(F.max("id").alias("id")).where("sample_id % 10 = 0")
    painted = inst.select("sample_id", "id").join(top, ["sample_id", "id"], "left_anti")
    return G.benchmark_errors(samples, inst, painted, {"samples": -1})


@query("s17_thresholds", """
    SELECT 'satellites' AS feature_type, ceil(quantile_cont(area::DOUBLE, 0.01)) AS min_area, 0.83::DOUBLE AS min_solidity, 999.0::DOUBLE AS aspect_sym_moment_max FROM gt_m WHERE type_label = 'satellites'""")
def _(t):
    from maskwright.catalog.scores import stats

    rec = tradeoff.filter_recommendations(tradeoff.mask_stats_summary(stats(t), ("area",)))
    return G.thresholds_from(rec, "satellites", {"min_area": 30, "min_solidity": 0.83, "aspect_sym_moment_max": 1.75})


@query("s4_prediction_documents", """
    SELECT p.image_id, 'raw' AS layer, n AS n_predictions, b.first_area, b.first_box FROM (SELECT image_id, count(*) AS n, min(inst_id) AS inst_id FROM pred GROUP BY ALL) p JOIN (
      SELECT image_id, inst_id, count(*) AS first_area, '[' || min(x) || '.0,' || min(y) || '.0,' || (max(x) - min(x) + 1) || '.0,' || (max(y) - min(y) + 1) || '.0]' AS first_box FROM pred_px GROUP BY ALL) b USING (image_id, inst_id)""")
def _(t):
    """Documents per image, read back: the count, and area and box of the first prediction."""
    from maskwright.operators.dataset import assign_stable_ids
    from maskwright.sources.masks import encode_rle
    from maskwright.sources.writers import prediction_documents

    key = ["image_id", "inst_id"]
    box = R.bboxes(t.pred_runs).withColumnsRenamed({"bbox_w": "bbox_w_px", "bbox_h": "bbox_h_px"})
    m = t.pred_m.join(encode_rle(t.pred_runs, SIDE, SIDE).select(*key, "counts"), key).join(box, key)
    docs = prediction_documents(assign_stable_ids(m, [F.col("inst_id")]), SIDE, SIDE)
    n = F.get_json_object("value", "$.n_predictions").cast("long")
    first = [F.get_json_object("value", f"$.predictions[0].{k}") for k in ("area", "bbox_xywh")]
    return docs.select("image_id", "layer", n.alias("n_predictions"), first[0].cast("long").alias("first_area"), first[1].alias("first_box"))


@query("r20_reserved_max", """
    SELECT image_id, max(v)::BIGINT AS max_reserved_id FROM (SELECT image_id, unnest([a, d]) AS v FROM log WHERE status <> 'failed') WHERE v IS NOT NULL GROUP BY ALL""",
    ctes={"log": """
    SELECT user_id::BIGINT AS image_id, CASE WHEN event_type = 'purchase' THEN event_id % 250 END AS a, CASE WHEN event_type = 'error' THEN event_id % 240 END AS d,
           CASE event_type WHEN 'signup' THEN 'failed' WHEN 'purchase' THEN 'committed' ELSE 'prepared' END AS status FROM events"""})
def _(t):
    from maskwright.catalog.reviewing import audit_log
    from maskwright.streaming.audit import reserved_max

    return reserved_max(audit_log(t))
