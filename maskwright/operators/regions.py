"""Sky regions and catalogues: galaxies with shapes, pixel outlines, rasters, benchmark tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from maskwright.functions.policies import literal_map
from maskwright.operators.numbering import number_rows
from maskwright.operators.runs import areas, bboxes, merge_tiles, paint, union_runs
from maskwright.operators.tiles import runs_of, tile_rows

# Surveys used, cutout size, class ids and bindings, catalogue fields.
SURVEYS = ("MATLAS", "CFIS,MATLAS")
FOV_ARCMIN, SIDE_PX = 31.0, 1024
REGION_CLASSES = {"Inner": 0, "Halo": 1, "Shells": 2, "Stream": 3, "Tail": 4}
BINDING = {"Stream": "positive", "Tail": "positive", "Halo": "positive", "Shells": "positive", "Inner": "ignore"}
CATALOGUE_FIELDS = ("x", "y", "geo_x", "geo_y", "area", "dmin", "dmax", "dmed", "gini", "axis_ratio", "orientation_angle",
                    "mag_fltr", "sb_fltr", "mag_g", "mag_r", "mag_g_nodust", "mag_r_nodust")


def assemble_galaxies(table: DataFrame, shapes: DataFrame, surveys: Sequence[str] = SURVEYS) -> DataFrame:
    """Eligible galaxies with the sky box of their shapes and the fixed cutout."""
    v = shapes.select("galaxy", "feature_id", F.explode("verts").alias("p"))
    box = v.groupBy("galaxy").agg(F.count_distinct("feature_id").alias("n_shapes"), F.min("p.ra").alias("ra_min"), F.max("p.ra").alias("ra_max"),
                                  F.min("p.dec").alias("dec_min"), F.max("p.dec").alias("dec_max"))
    out = table.where(F.col("survey").isin(*surveys)).join(box, "galaxy", "left")
    return out.withColumn("n_shapes", F.coalesce("n_shapes", F.lit(0))).withColumn("fov_arcmin", F.lit(FOV_ARCMIN)).withColumn(
        "pix_arcsec", F.lit(FOV_ARCMIN * 60.0 / SIDE_PX))


def radec_to_pixel(points: DataFrame) -> DataFrame:
    """Tangent-plane pixel (0-based) of ra, dec with the header columns crval, crpix, cd of their image."""
    ra, dec, ra0, dec0 = (F.radians(F.col(c)) for c in ("ra", "dec", "crval1", "crval2"))
    cosc = F.sin(dec0) * F.sin(dec) + F.cos(dec0) * F.cos(dec) * F.cos(ra - ra0)
    xi = F.degrees(F.cos(dec) * F.sin(ra - ra0) / cosc)
    eta = F.degrees((F.cos(dec0) * F.sin(dec) - F.sin(dec0) * F.cos(dec) * F.cos(ra - ra0)) / cosc)
    out = points.withColumn("_xi", xi).withColumn("_eta", eta).withColumn("_det", F.expr("cd11 * cd22 - cd12 * cd21"))
    return out.withColumn("px", F.expr("(cd22 * _xi - cd12 * _eta) / _det + crpix1 - 1")).withColumn(
        "py", F.expr("(cd11 * _eta - cd21 * _xi) / _det + crpix2 - 1")).drop("_xi", "_eta", "_det")


def raster_rows(shapes: DataFrame, height: int, width: int, thickness: int = 3) -> DataFrame:
    """Tile rows of shapes: filled polygons with their outline, open lines of some thickness.

    ``shapes``: image_id, inst_id, kind (polygon or line), verts ARRAY<STRUCT<x, y>> in pixels.
    Coordinates are truncated. Everything stays per edge and scan line; the crossings collected for
    one line of one polygon are at most its number of edges. Outline and inside meet in one ``bit_or``: nothing
    is sorted by pixel.
    """
    key = ["image_id", "inst_id"]
    ints = shapes.withColumn("v", F.expr("transform(verts, p -> struct(cast(p.x as int) as x, cast(p.y as int) as y))"))
    last = F.when(F.col("kind") == "polygon", F.size("v")).otherwise(F.size("v") - 1)
    edge = ints.where("size(v) >= 2").select(*key, "kind", "v", F.explode(F.expr("sequence(0, size(v) - 1)")).alias("i"), last.alias("_n")).where("i < _n")
    edge = edge.select(*key, "kind", F.expr("v[i].x as ax"), F.expr("v[i].y as ay"), F.expr("v[(i + 1) % size(v)].x as bx"), F.expr("v[(i + 1) % size(v)].y as by_"))
    steps = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by_") - F.col("ay")))
    walk = edge.withColumn("n", steps).select("*", F.explode(F.expr("sequence(0, n)")).alias("k"))
    dots = walk.select(*key, "kind", F.expr("cast(round(ax + case when n = 0 then 0 else k * (bx - ax) / n end) as int) as x"),
                       F.expr("cast(round(ay + case when n = 0 then 0 else k * (by_ - ay) / n end) as int) as y"))
    lo, hi = -((thickness - 1) // 2), thickness // 2
    line = "kind = 'line'"
    thick = dots.withColumn("dy", F.explode(F.expr(f"case when {line} then sequence({lo}, {hi}) else array(0) end")))
    outline = thick.select(*key, F.expr("y + dy as y"), F.expr(f"greatest(0, x + case when {line} then {lo} else 0 end) as x0"),
                           F.expr(f"least({width}, x + 1 + case when {line} then {hi} else 0 end) as x1")).where(f"y BETWEEN 0 AND {height - 1} AND x0 < x1")
    cross = edge.where("kind = 'polygon' and ay <> by_").select(*key, "ax", "ay", "bx", "by_", F.explode(F.expr("sequence(least(ay, by_), greatest(ay, by_) - 1)")).alias("y"))
    cross = cross.select(*key, "y", F.expr("ax + (y - ay) * (bx - ax) / (by_ - ay)").alias("cx")).where(f"y BETWEEN 0 AND {height - 1}")
    lines = cross.groupBy(*key, "y").agg(F.array_sort(F.collect_list("cx")).alias("c"))
    pairs = lines.select(*key, "y", "c", F.explode(F.expr("sequence(0, size(c) div 2 - 1)")).alias("j"))
    inner = pairs.select(*key, "y", F.expr("cast(greatest(0, ceil(c[2 * j])) as int) as x0"), F.expr(f"cast(least({width}, floor(c[2 * j + 1]) + 1) as int) as x1")).where("x0 < x1")
    return tile_rows(inner.unionByName(outline.select(*inner.columns)), key)


def rasterize_shapes(shapes: DataFrame, height: int, width: int, thickness: int = 3) -> DataFrame:
    """Runs of the shapes of ``raster_rows``, not cut at tile borders."""
    key = ["image_id", "inst_id"]
    return merge_tiles(runs_of(raster_rows(shapes, height, width, thickness), key).drop("tile"), key)


def bind_classes(runs: DataFrame, shapes: DataFrame, binding: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Label map of positive shapes (earlier shapes keep their pixels) and the union of each class."""
    role = literal_map(binding or BINDING)
    typed = runs.join(shapes.select("image_id", "inst_id", "type"), ["image_id", "inst_id"])
    positive = typed.where(role[F.col("type")] == "positive")
    ids = number_rows(positive.select("image_id", "inst_id").distinct(), ["image_id"], [F.col("inst_id")], "label_id")
    painted = paint(positive.join(ids, ["image_id", "inst_id"]), -F.col("label_id"), label="label_id")
    return painted, union_runs(typed, ["image_id", "type"])


def annotate_shapes(shapes: DataFrame, runs: DataFrame) -> DataFrame:
    """Annotation rows: class id, box and area; empty masks are left out."""
    key = ["image_id", "inst_id"]
    rows = shapes.join(areas(runs), key).join(bboxes(runs), key)
    rows = rows.withColumn("category_id", literal_map(REGION_CLASSES)[F.col("type")].cast("long"))
    return number_rows(rows, [], [F.col("image_id"), F.col("inst_id")], "id").select("id", *key, "category_id", "type", "kind", "area", "bbox_x", "bbox_y", "bbox_w", "bbox_h")


def galaxy_index(galaxies: DataFrame, shapes: DataFrame) -> DataFrame:
    """One JSON record per galaxy with its shapes nested."""
    nested = shapes.groupBy("galaxy").agg(F.array_sort(F.collect_list(F.struct("feature_id", "type", "kind", "verts"))).alias("shapes"))
    rows = galaxies.join(nested, "galaxy", "left")
    return rows.select("galaxy", F.to_json(F.struct(*rows.columns)).alias("record"))


def read_galaxy_index(records: DataFrame, schema: str) -> DataFrame:
    return records.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("g")).select("g.*")


def benchmark_instances(catalogue: DataFrame, samples: DataFrame, fields: Sequence[str] = CATALOGUE_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Numbered instances (1..N by numeric object id, figures rounded to 8 places) and sample counts, empty samples kept."""
    figures = [F.bround(F.col(c).cast("double"), 8).alias(c) for c in fields if c in catalogue.columns]
    inst = number_rows(catalogue, ["sample_id"], [F.col("sat_id")], "id").select("sample_id", "id", F.concat(F.lit("id"), F.col("sat_id").cast("string")).alias("source_object_id"), *figures)
    n = inst.groupBy("sample_id").agg(F.count(F.lit(1)).alias("instance_count"))
    out = samples.join(n, "sample_id", "left").withColumn("instance_count", F.coalesce("instance_count", F.lit(0)))
    return inst, out.withColumn("is_empty_sample", F.col("instance_count") == 0)


def benchmark_errors(samples: DataFrame, instances: DataFrame, painted: DataFrame, expected: dict[str, int]) -> DataFrame:
    """All integrity errors as rows (sample_id NULL for totals): counts, id continuity, empty samples.

    ``samples``: sample_id, galaxy_id, instance_count, is_empty_sample; ``instances``: sample_id, id;
    ``painted``: sample_id, id of labels found in the maps.
    """
    listed = instances.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    seen = painted.distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("_k"), F.max("id").alias("_max"), F.min("id").alias("_min"))
    s = samples.join(listed, "sample_id", "left").join(seen, "sample_id", "left").na.fill(0, ["_n", "_k", "_max"])
    rules = {
        "empty_sample_painted": "is_empty_sample AND _max <> 0", "empty_sample_listed": "is_empty_sample AND _n <> 0",
        "max_id_differs": "NOT is_empty_sample AND _max <> _n", "ids_not_contiguous": "NOT is_empty_sample AND (_k <> _n OR _min <> 1 OR _max <> _n)",
        "count_mismatch": "instance_count <> _n"}
    per = s.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()]))).alias("error"))
    total = s.agg(F.count_distinct("galaxy_id").alias("galaxies"), F.count(F.lit(1)).alias("samples"), F.sum("_n").alias("instances"), F.count_if("is_empty_sample").alias("empty_samples"))
    checks = [F.when(F.col(k) != v, F.lit(f"total_{k}")) for k, v in expected.items()]
    return per.unionByName(total.select(F.lit(None).cast(per.schema["sample_id"].dataType).alias("sample_id"), F.explode(F.array_compact(F.array(*checks))).alias("error")))


def thresholds_from(recommendations: DataFrame, feature: str, defaults: dict[str, float], ceil: Sequence[str] = ("min_area", "max_area")) -> DataFrame:
    """One row of thresholds of a feature; missing rows or columns give the defaults, areas are rounded up."""
    base = recommendations.sparkSession.range(1).select(F.lit(feature).alias("feature_type"))
    row = base.join(recommendations, "feature_type", "left")
    out = []
    for name, default in defaults.items():
        value = F.col(name).cast("double") if name in recommendations.columns else F.lit(None).cast("double")
        value = F.ceil(value).cast("double") if name in ceil else value
        out.append(F.coalesce(value, F.lit(None if default is None else float(default)).cast("double")).alias(name))
    return row.select("feature_type", *out)

