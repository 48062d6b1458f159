"""Named queries: identities, numbering, splits, merging, augmentation and their checks."""

from pyspark.sql import functions as F

from maskwright.catalog import query
from maskwright.operators import dataset as D
from maskwright.operators.numbering import number_rows

VIEWS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# Images from orders, annotations from line items, files and renders from both.
COCO = {
    "imgs": """
    SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS galaxy_id, 'v' || substr(o_orderpriority, 1, 1) AS view_id,
           CASE o_orderstatus WHEN 'F' THEN 'linear_magnitude' WHEN 'O' THEN 'asinh_stretch' ELSE 'multi_exposure' END AS variant,
           printf('%05d', o_custkey) || '_v' || substr(o_orderpriority, 1, 1) AS base_key,
           'images/' || printf('%05d', o_custkey) || '_v' || substr(o_orderpriority, 1, 1) || '_' || o_orderkey || '.png' AS file_name, 256 AS width, 256 AS height FROM orders""",
    "anns": """
    SELECT CAST(l_orderkey AS BIGINT) AS image_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey AS BIGINT) AS supp,
           min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)::BIGINT AS category_id, min(CAST(l_quantity AS BIGINT))::BIGINT AS area
    FROM lineitem GROUP BY ALL""",
    "sided": """SELECT *, CASE WHEN ('0x' || substr(sha256('42:' || galaxy_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.8::DOUBLE THEN 'train' ELSE 'val' END AS split FROM imgs""",
    "sided_prior": """SELECT * REPLACE (CASE WHEN galaxy_id % 10 = 0 THEN 'val' WHEN galaxy_id % 10 = 1 THEN 'train' ELSE split END AS split) FROM sided""",
}


def imgs(t):
    view = F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1))
    key = F.concat(F.format_string("%05d", F.col("o_custkey")), F.lit("_"), view)
    return t.orders.select(
        F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("galaxy_id"), view.alias("view_id"),
        F.when(F.col("o_orderstatus") == "F", "linear_magnitude").when(F.col("o_orderstatus") == "O", "asinh_stretch").otherwise("multi_exposure").alias("variant"),
        key.alias("base_key"), F.concat(F.lit("images/"), key, F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file_name"),
        F.lit(256).alias("width"), F.lit(256).alias("height"))


def anns(t):
    cat = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("long")
    return t.lineitem.groupBy(*[F.col(f"l_{a}").cast("long").alias(b) for a, b in (("orderkey", "image_id"), ("linenumber", "line"), ("partkey", "part"), ("suppkey", "supp"))]).agg(
        F.min(cat).alias("category_id"), F.min(F.col("l_quantity").cast("long")).alias("area"))


def prior(t):
    return imgs(t).select("galaxy_id").distinct().where("galaxy_id % 10 < 2").withColumn(
        "prior_split", F.when(F.col("galaxy_id") % 10 == 0, "val").otherwise("train"))


@query("s13_parse_names", """
    SELECT CAST(split_part(base_key, '_', 1) AS INTEGER) AS galaxy_id, split_part(base_key, '_', 2) AS view_id, count(*) AS n FROM imgs GROUP BY ALL""", ctes=COCO)
def _(t):
    return imgs(t).select(D.parse_base_key(F.col("base_key")).alias("k")).select("k.*").groupBy("galaxy_id", "view_id").agg(F.count(F.lit(1)).alias("n"))


@query("s13_sample_names", """
    SELECT galaxy_id, orientation, threshold, type, count(*) AS n FROM (
      SELECT CASE WHEN image_id % 5 = 0 THEN NULL ELSE image_id::INTEGER END AS galaxy_id, CASE WHEN image_id % 5 = 0 THEN NULL ELSE 'eo' END AS orientation,
             CASE WHEN image_id % 5 = 0 THEN NULL ELSE 27.5::DOUBLE END AS threshold, CASE WHEN image_id % 5 = 0 THEN NULL ELSE 'streams' END AS type FROM images) GROUP BY ALL""")
def _(t):
    name = F.when(F.col("image_id") % 5 == 0, F.lit("readme.txt")).otherwise(F.format_string("%05d_eo_SB27.5_streams", F.col("image_id")))
    return t.images.select(D.parse_sample_name(name).alias("s")).select("s.*").groupBy("galaxy_id", "orientation", "threshold", "type").agg(F.count(F.lit(1)).alias("n"))


_FILES = {**COCO, "files": """
    SELECT 'sb30' AS profile, base_key, 'root/' || CASE WHEN id % 3 = 0 THEN printf('%05d', galaxy_id) || '/' ELSE '' END || 'x' || id || '.gz' AS path, id % 3 = 0 AS g FROM imgs"""}


@query("s14_prefer_grouped", """
    SELECT profile, base_key, path FROM (SELECT *, row_number() OVER (PARTITION BY profile, base_key ORDER BY g DESC, path) AS rn FROM files) WHERE rn = 1""", ctes=_FILES)
def _(t):
    path = F.concat(F.lit("root/"), F.when(F.col("id") % 3 == 0, F.concat(F.format_string("%05d", F.col("galaxy_id")), F.lit("/"))).otherwise(""), F.lit("x"), F.col("id").cast("string"), F.lit(".gz"))
    return D.prefer_grouped_source(imgs(t).select(F.lit("sb30").alias("profile"), "base_key", path.alias("path")))


@query("s15_regroup", """
    SELECT 'clean' AS condition, galaxy_id::INTEGER AS galaxy_id, count(DISTINCT view_id) AS n_views, count(DISTINCT view_id) = 5 AS complete FROM imgs GROUP BY ALL""", ctes=COCO)
def _(t):
    files = imgs(t).select(F.lit("clean").alias("condition"), F.concat(F.lit("flat/"), F.col("base_key"), F.lit(".fits.gz")).alias("path"))
    return D.regroup_plan(files, views_complete=5)[1]


@query("s12_enumerate_grid", """
    SELECT galaxy_id, 'v' || v AS view_id, printf('%05d', galaxy_id) || '_v' || v AS base_key FROM (SELECT DISTINCT galaxy_id FROM imgs), (SELECT unnest(range(1, 6)) AS v)""", ctes=COCO)
def _(t):
    from maskwright.sources.readers import enumerate_grid

    return enumerate_grid(imgs(t).select("galaxy_id").distinct(), [f"v{i}" for i in range(1, 6)])


@query("w1_stable_ids", """
    SELECT image_id, inst_id, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) - 1 AS raw_index,
           CASE type_label WHEN 'satellites' THEN 'sat' ELSE 'tidal_fe' END || printf('_%04d', row_number() OVER (PARTITION BY image_id, type_label ORDER BY inst_id) - 1) AS candidate_id,
           substr(sha1(y0 || ',' || x0 || ',' || y1 || ',' || x1), 1, 16) AS candidate_rle_sha1 FROM pred""")
def _(t):
    m = t.pred.withColumn("counts", F.concat_ws(",", "y0", "x0", "y1", "x1"))
    return D.assign_stable_ids(m, [F.col("inst_id")]).select("image_id", "inst_id", "raw_index", "candidate_id", "candidate_rle_sha1")


@query("w2_renumber", """
    SELECT row_number() OVER (ORDER BY a.image_id, line, part, supp) AS id, i.n AS image_id, category_id, area
    FROM anns a JOIN (SELECT id, row_number() OVER (ORDER BY id) AS n FROM imgs) i ON i.id = a.image_id""", ctes=COCO)
def _(t):
    _, a = D.renumber(imgs(t), anns(t), [F.col("id")], [F.col(c) for c in ("image_id", "line", "part", "supp")])
    return a.select("id", "image_id", "category_id", "area")


@query("w3_order_instances", """
    SELECT image_id, inst_id, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, centroid_x, centroid_y, inst_id) AS rank
    FROM (SELECT *, round(cx, 2) AS centroid_x, round(cy, 2) AS centroid_y FROM gt_m)""")
def _(t):
    m = t.gt_m.withColumn("centroid_x", F.round("cx", 2)).withColumn("centroid_y", F.round("cy", 2))
    return D.order_instances(m, ["area_desc", "centroid_x_asc", "centroid_y_asc"]).select("image_id", "inst_id", "rank")


@query("w4_replay_ids", """
    SELECT p.image_id, p.inst_id, coalesce(m.top, 0) + row_number() OVER (PARTITION BY p.image_id ORDER BY area DESC, p.inst_id) AS instance_id
    FROM (SELECT * FROM pred_m WHERE type_label = 'satellites') p LEFT JOIN (SELECT image_id, max(inst_id) AS top FROM gt WHERE type_label = 'tidal_features' GROUP BY ALL) m USING (image_id)""")
def _(t):
    top = t.gt.where("type_label = 'tidal_features'").groupBy("image_id").agg(F.max("inst_id").alias("max_stream_id"))
    return D.replay_instance_ids(t.sats, top, ["area_desc"]).select("image_id", "inst_id", "instance_id")


@query("w5_sort_by_area", """
    SELECT image_id, inst_id, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, inst_id) AS rank FROM gt_m WHERE type_label = 'satellites'""")
def _(t):
    return number_rows(t.gt_m.where("type_label = 'satellites'"), ["image_id"], [F.col("area").desc(), F.col("inst_id")], "rank").select("image_id", "inst_id", "rank")


@query("w6_top_groups", """
    SELECT variant AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, variant) AS rank FROM imgs GROUP BY variant""", ctes=COCO)
def _(t):
    from maskwright.operators.tradeoff import count_by_key

    return number_rows(count_by_key(imgs(t), "variant"), [], [F.col("n").desc(), F.col("key")], "rank")


@query("e16_mask_source", """
    SELECT b.image_id, b.inst_id, CASE WHEN p.inst_id IS NOT NULL THEN 'prediction' WHEN b.q % 7 = 0 THEN 'missing' WHEN b.q % 2 = 0 THEN 'class_map' ELSE 'legacy_map' END AS mask_source
    FROM boxes b LEFT JOIN pred p USING (image_id, inst_id)""")
def _(t):
    inst = t.boxes.select("image_id", "inst_id", F.col("inst_id").alias("raw_index"), F.when(F.col("q") % 7 == 0, "sam3_post").alias("source"),
                          F.when(F.col("q") % 2 == 0, "x.npy").alias("map_file"), F.when(F.col("q") % 2 == 0, F.col("inst_id")).alias("local_id"))
    return D.resolve_mask_source(inst, t.pred.select("image_id", F.col("inst_id").alias("raw_index"))).select("image_id", "inst_id", "mask_source")


@query("e21_select_candidate", """
    SELECT inst_id AS request_id, image_id, CASE WHEN inst_id % 4 = 3 THEN 'none' ELSE 'ok' END AS status, CASE WHEN inst_id % 4 <> 3 THEN inst_id END AS raw_index FROM pred""")
def _(t):
    p = t.pred.select("image_id", F.col("inst_id").alias("raw_index"), F.concat(F.lit("c"), F.col("inst_id").cast("string")).alias("candidate_id"),
                      F.concat(F.lit("h"), F.col("inst_id").cast("string")).alias("candidate_rle_sha1"))
    k = F.col("raw_index") % 4
    r = p.select(F.col("raw_index").alias("request_id"), "image_id", F.when(k.isin(0, 1), F.col("candidate_id")).when(k == 3, "wrong").alias("candidate_id"),
                 F.when(k == 2, F.col("raw_index")).alias("raw_index"), F.when(k.isin(0, 3), F.col("candidate_rle_sha1")).alias("candidate_rle_sha1"))
    return D.select_candidate(r, p)


@query("d1_export_annotations", """
    SELECT i.id AS image_id, a.line, CASE WHEN a.category_id = 3 THEN 2 ELSE a.category_id END AS category_id, a.area FROM imgs i JOIN anns a ON a.image_id = i.id WHERE i.variant <> 'multi_exposure' AND a.area > 0""", ctes=COCO)
def _(t):
    """Images with a render only; 'inner' rows are relabelled to satellites before export."""
    have = imgs(t).where("variant <> 'multi_exposure'")
    images = have.select("id", F.col("id").cast("string").alias("base_key"))
    inst = anns(t).select(F.col("image_id").cast("string").alias("base_key"), F.struct("line", "part", "supp").alias("inst_id"),
                          F.when(F.col("category_id") == 1, "streams").otherwise("satellite galaxies").alias("type_label"))
    masks = anns(t).select(F.col("image_id").cast("string").alias("base_key"), F.struct("line", "part", "supp").alias("inst_id"), "area",
                           *[F.lit(0.0).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")])
    return D.export_annotations(images, inst, masks).select("image_id", F.col("inst_id.line").alias("line"), "category_id", "area")


@query("d1_export_images", """
    SELECT DISTINCT k.base_key, v.variant, 'images/' || k.base_key || '_' || v.variant || '.png' AS file_name FROM (SELECT DISTINCT base_key FROM imgs) k
    JOIN (SELECT DISTINCT base_key, variant FROM imgs) v USING (base_key)""", ctes=COCO)
def _(t):
    samples = imgs(t).select("base_key").distinct().withColumn("condition", F.lit("clean"))
    renders = imgs(t).select("base_key", "variant").distinct().withColumn("condition", F.lit("clean"))
    return D.export_images(samples, ["linear_magnitude", "asinh_stretch", "multi_exposure"], renders).select("base_key", "variant", "file_name")


@query("d2_provenance", """
    SELECT image_id, inst_id, CASE WHEN q % 3 = 0 THEN '{"label_source":"manual","human_fix":true}' WHEN q % 3 = 1 THEN '{"human_fix":true,"source_raw_index":' || inst_id || '}' ELSE '{"human_fix":true}' END AS provenance FROM boxes""")
def _(t):
    rows = t.boxes.select("image_id", "inst_id", F.when(F.col("q") % 3 == 0, "manual").alias("label_source"), F.lit(True).alias("human_fix"),
                          F.when(F.col("q") % 3 == 1, F.col("inst_id")).alias("source_raw_index"))
    return D.provenance_json(rows).select("image_id", "inst_id", "provenance")


@query("d3_group_split", "SELECT id, galaxy_id, split FROM sided_prior", ctes=COCO)
def _(t):
    return D.group_split(imgs(t), prior=prior(t)).select("id", "galaxy_id", "split")


@query("d3_split_manifest", """
    SELECT split, count(DISTINCT galaxy_id) AS n_groups, count(*) AS n_images, sum(coalesce(a.n, 0))::BIGINT AS n_annotations
    FROM sided LEFT JOIN (SELECT image_id, count(*) AS n FROM anns GROUP BY ALL) a ON a.image_id = sided.id GROUP BY ALL""", ctes=COCO)
def _(t):
    return D.split_manifest(D.group_split(imgs(t)), anns(t))


@query("d4_holdout_split", """
    SELECT doc_id, source, CASE WHEN ('0x' || substr(sha256('7:' || source), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.7::DOUBLE THEN 'train' ELSE 'holdout' END AS split FROM documents""")
def _(t):
    return D.holdout_split(t.documents.select("doc_id", "source"), F.col("source"), 0.3, 7)


_TWO = {**COCO, "two": """
    SELECT id, file_name, galaxy_id, CASE WHEN id % 4 = 0 THEN 300 ELSE width END AS width, 1 AS r, variant FROM imgs WHERE id % 2 = 0
    UNION ALL SELECT id, file_name, galaxy_id, width, 0, variant FROM imgs WHERE id % 3 <> 1"""}


@query("d5_compose", """
    SELECT file_name, min(r)::INTEGER AS source_rank, arg_min(width, r)::INTEGER AS width FROM two GROUP BY file_name""", ctes=_TWO)
def _(t):
    return _composed(t)[0].select("file_name", "source_rank", "width")


def _composed(t):
    i, a = imgs(t), anns(t)
    b = i.where("id % 2 = 0").withColumn("width", F.when(F.col("id") % 4 == 0, 300).otherwise(F.col("width")))
    return D.compose([("first", i.where("id % 3 <> 1"), a), ("second", b, a.withColumn("area", F.when(F.col("image_id") % 10 == 6, F.col("area") + 1).otherwise(F.col("area"))))])


@query("d5_duplicates", """
    SELECT file_name, concat_ws(',', CASE WHEN id % 4 = 0 THEN 'width' END, CASE WHEN id % 10 = 6 AND EXISTS (SELECT 1 FROM anns a WHERE a.image_id = imgs.id) THEN 'annotations' END) AS differs
    FROM imgs WHERE id % 2 = 0 AND id % 3 <> 1""", ctes=COCO)
def _(t):
    return _composed(t)[2]


@query("d5_category_mismatch", """
    SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN k = 0 THEN 'lsb' ELSE 'other' END AS supercategory, k AS only_in FROM nation, (SELECT unnest([0, 1]) AS k) WHERE n_nationkey % 5 = 0""")
def _(t):
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("lsb").alias("supercategory"))
    return D.category_mismatch([a, a.withColumn("supercategory", F.when(F.col("id") % 5 == 0, "other").otherwise("lsb"))])


_AUG = {**COCO, "aug": """
    SELECT id AS source_image_id_in_base, c.r::INTEGER AS copy_rank, c.t AS noise_tag, variant, galaxy_id,
           CASE WHEN c.r = 0 THEN file_name ELSE 'images/' || base_key || '_' || variant || '__noise_' || replace(c.t, '.', 'p') || '.png' END AS file_name
    FROM imgs JOIN (SELECT unnest([0, 1, 2]) AS r, unnest(['clean', 'sb30', 'sb31.5']) AS t) c ON c.r = 0 OR variant = 'linear_magnitude'"""}
_TAGS = ["sb30", "sb31.5"]


@query("d6_noise_augment", "SELECT source_image_id_in_base, copy_rank, noise_tag, file_name FROM aug", ctes=_AUG)
def _(t):
    return D.noise_augment(imgs(t), anns(t).withColumn("id", F.col("line")), _TAGS)[0].select("source_image_id_in_base", "copy_rank", "noise_tag", "file_name")


@query("d6_augmented_annotations", """
    SELECT noise_tag, count(*) AS n, sum(area)::BIGINT AS area FROM aug JOIN anns ON anns.image_id = source_image_id_in_base GROUP BY ALL""", ctes=_AUG)
def _(t):
    i, a = D.noise_augment(imgs(t), anns(t).withColumn("id", F.col("line")), _TAGS)
    tag = F.when(F.col("copy_rank") == 0, "clean").otherwise(F.array(*[F.lit(x) for x in _TAGS])[F.col("copy_rank") - 1])
    return a.withColumn("noise_tag", tag).groupBy("noise_tag").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


@query("d7_leakage", """
    SELECT galaxy_id, CASE WHEN galaxy_id % 10 = 0 THEN 'in_other_side' ELSE 'outside_own_side' END AS problem FROM (SELECT DISTINCT galaxy_id FROM imgs) WHERE galaxy_id % 10 <> 1""", ctes=COCO)
def _(t):
    return D.leakage(imgs(t), prior(t).withColumnRenamed("prior_split", "split"), "train")


@query("d7_manifest_overlap", "SELECT DISTINCT galaxy_id FROM imgs WHERE galaxy_id % 20 = 0", ctes=COCO)
def _(t):
    m = prior(t).select("galaxy_id", F.col("prior_split").alias("split"))
    return D.manifest_overlap(m.unionByName(m.where("galaxy_id % 20 = 0").withColumn("split", F.lit("train"))))


@query("d8_not_augmented", "SELECT source_image_id_in_base AS id, copy_rank FROM aug WHERE copy_rank > 0", ctes=_AUG)
def _(t):
    return D.already_augmented(D.noise_augment(imgs(t), anns(t).withColumn("id", F.col("line")), _TAGS)[0]).select("id", "copy_rank")


@query("d9_dimensions", """
    SELECT id, CASE WHEN id % 7 = 0 THEN 'missing' ELSE 'size' END AS problem FROM imgs WHERE id % 7 = 0 OR id % 11 = 0""", ctes=COCO)
def _(t):
    r = imgs(t).where("id % 7 <> 0").select("id", F.when(F.col("id") % 11 == 0, 512).otherwise(256).alias("render_width"), F.lit(256).alias("render_height"))
    return D.dimension_check(imgs(t), r, ["id"]).select("id", "problem")


@query("d10_coverage", """
    SELECT base_key, noise_tag FROM (SELECT DISTINCT base_key FROM imgs), (SELECT unnest(['sb30', 'sb31.5']) AS noise_tag)
    EXCEPT SELECT base_key, noise_tag FROM (SELECT DISTINCT base_key, variant FROM imgs WHERE variant = 'linear_magnitude'), (SELECT unnest(['sb30', 'sb31.5']) AS noise_tag)""", ctes=COCO)
def _(t):
    have = imgs(t).where("variant = 'linear_magnitude'").select("base_key", F.explode(F.array(*[F.lit(x) for x in _TAGS])).alias("noise_tag"))
    return D.coverage_missing(imgs(t), have, _TAGS)


@query("d11_expected_counts", """
    SELECT count(*) AS n_images, (SELECT count(*) FROM aug JOIN anns ON anns.image_id = source_image_id_in_base) AS n_annotations FROM aug""", ctes=_AUG)
def _(t):
    return D.expected_counts(imgs(t), anns(t), len(_TAGS))


@query("d11_view_problems", "SELECT id, CASE WHEN view_id = 'v5' THEN 'view' ELSE 'base_key' END AS problem FROM imgs WHERE view_id = 'v5' OR galaxy_id % 10 = 3", ctes=COCO)
def _(t):
    i = imgs(t).withColumn("noise_tag", F.lit("clean")).withColumn("base_key", F.when(F.col("galaxy_id") % 10 == 3, "bad").otherwise(F.col("base_key")))
    return D.view_problems(i, ["v1", "v2", "v3", "v4"], r"^\d{5,}_v[1-5]$", ["linear_magnitude"]).select("id", "problem")


@query("d12_rebuild", """
    SELECT split, row_number() OVER (PARTITION BY split ORDER BY least(copy_rank, 1), source_image_id_in_base, copy_rank) AS id, file_name
    FROM aug JOIN (SELECT id AS source_image_id_in_base, split FROM sided_prior) USING (source_image_id_in_base)""", ctes=_AUG)
def _(t):
    i, _ = D.rebuild_dataset(imgs(t), anns(t).withColumn("id", F.struct("line", "part", "supp")), _TAGS, prior=prior(t))
    return i.select("split", "id", "file_name")


@query("d13_clone_condition", """
    SELECT image_id, inst_id, condition, 'clean' AS cloned_from_condition, 'inherited_from_clean' AS label_mode FROM gt, (SELECT unnest(['sb30', 'sb31.5']) AS condition)""")
def _(t):
    return D.clone_condition(t.gt.select("image_id", "inst_id"), _TAGS)


@query("d14_shadow_bootstrap", "SELECT image_id, inst_id FROM gt WHERE type_label = 'tidal_features'")
def _(t):
    return D.shadow_bootstrap(t.gt, stream_label="tidal_features").select("image_id", "inst_id")


@query("d16_threshold_categories", """
    SELECT (k * 2 + s + 1)::BIGINT AS id, CASE s WHEN 0 THEN 'stellar_stream_SB' ELSE 'satellite_SB' END || CASE WHEN th = floor(th) THEN th::BIGINT::VARCHAR ELSE th::VARCHAR END AS name,
           CASE s WHEN 0 THEN 'stellar_stream' ELSE 'satellite' END AS supercategory, th AS threshold
    FROM (SELECT n_nationkey AS k, 27 + n_nationkey / 2.0::DOUBLE AS th FROM nation), (SELECT unnest([0, 1]) AS s)""")
def _(t):
    return D.threshold_categories(t.nation.select((27 + F.col("n_nationkey") / 2.0).alias("threshold"), F.col("n_nationkey").alias("position")))


@query("d17_pending", """
    SELECT DISTINCT base_key FROM imgs WHERE base_key NOT IN (SELECT base_key FROM (SELECT DISTINCT base_key, variant FROM imgs WHERE variant <> 'multi_exposure') GROUP BY ALL HAVING count(*) = 2)""", ctes=COCO)
def _(t):
    art = imgs(t).select("base_key", F.col("variant").alias("artifact"))
    return D.pending_samples(imgs(t).select("base_key").distinct(), art, ["linear_magnitude", "asinh_stretch"])


@query("d13_missing_artifacts", """
    SELECT base_key, artifact FROM (SELECT DISTINCT base_key FROM imgs), (SELECT unnest(['linear_magnitude', 'asinh_stretch']) AS artifact) EXCEPT SELECT base_key, variant FROM imgs""", ctes=COCO)
def _(t):
    return D.missing_artifacts(imgs(t), imgs(t).select("base_key", F.col("variant").alias("artifact")), ["linear_magnitude", "asinh_stretch"])


@query("d18_view_index", """
    SELECT galaxy_id, 'los' || printf('%02d', i) AS view_id, x AS vx, y AS vy, z AS vz, printf('%05d', galaxy_id) || '_los' || printf('%02d', i) AS base_key
    FROM (SELECT DISTINCT galaxy_id FROM imgs), (SELECT unnest([0, 1, 2]) AS i, unnest([1, 0, 0]::DOUBLE[]) AS x, unnest([0, 1, 0]::DOUBLE[]) AS y, unnest([0, 0, 1]::DOUBLE[]) AS z)""", ctes=COCO)
def _(t):
    return D.view_index(imgs(t).select("galaxy_id").distinct(), [(1, 0, 0), (0, 1, 0), (0, 0, 1)])[0]


@query("a34_manifest_counters", """
    SELECT image_id, count(*) AS n_raw, count(*) FILTER (score >= 0.5::DOUBLE) AS n_post, count(*) FILTER (score >= 0.5::DOUBLE AND type_label = 'tidal_features') AS n_tidal_features,
           count(*) FILTER (score >= 0.5::DOUBLE AND type_label = 'satellites') AS n_satellites, 0::BIGINT AS n_inner_galaxy, max(inst_id) FILTER (type_label = 'tidal_features') AS max_stream_id,
           max(inst_id) FILTER (score >= 0.5::DOUBLE) AS max_final_id FROM pred GROUP BY ALL""")
def _(t):
    return D.manifest_counters(t.pred.withColumn("kept_in_post", F.col("score") >= 0.5))


@query("a30_class_manifest", """
    SELECT galaxy_id AS galaxy, count(*) FILTER (variant = 'linear_magnitude') AS linear_magnitude, count(*) FILTER (variant = 'asinh_stretch') AS asinh_stretch, count(*) AS n_shapes FROM imgs GROUP BY ALL""", ctes=COCO)
def _(t):
    return D.class_manifest(imgs(t).select(F.col("galaxy_id").alias("galaxy"), F.col("variant").alias("type")), ["linear_magnitude", "asinh_stretch"])


@query("a35_annotation_tally", """
    SELECT base_key AS galaxy_view, id::VARCHAR AS variant, 1::BIGINT AS n_images, count(a.line) FILTER (category_id = 1) AS tidal, count(a.line) FILTER (category_id = 2) AS sats
    FROM imgs LEFT JOIN anns a ON a.image_id = imgs.id GROUP BY ALL""", ctes=COCO)
def _(t):
    return D.annotation_tally(imgs(t), anns(t), [(1, "tidal"), (2, "sats")])


@query("x10_file_seed", """
    SELECT base_key, 42 + (('0x' || right(sha256(galaxy_id || '_' || view_id || '_sb30'), 8))::BIGINT % 2147483648) AS seed FROM (SELECT DISTINCT base_key, galaxy_id, view_id FROM imgs)""", ctes=COCO)
def _(t):
    k = imgs(t).select("base_key", "galaxy_id", "view_id").distinct()
    return k.select("base_key", D.file_seed(42, F.col("galaxy_id").cast("string"), F.col("view_id"), F.lit("sb30")).alias("seed"))


@query("s6_coco_tables", "SELECT image_id, count(*) AS n, sum(area)::BIGINT AS area FROM anns GROUP BY ALL", ctes=COCO)
def _(t):
    """Annotations nested per image as in a document and flattened again."""
    doc = anns(t).groupBy("image_id").agg(F.collect_list(F.struct("line", "category_id", "area")).alias("annotations"))
    flat = doc.select("image_id", F.explode("annotations").alias("a"))
    return flat.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a.area").alias("area"))


@query("m3_start_length", """
    SELECT image_id, inst_id, string_agg(p, ',' ORDER BY s) AS counts FROM (
      SELECT image_id, inst_id, min(f) + 1 AS s, (min(f) + 1) || ',' || count(*) AS p FROM (
        SELECT *, f - row_number() OVER (PARTITION BY image_id, inst_id ORDER BY f) AS i FROM (SELECT image_id, inst_id, x * 256 + y AS f FROM gt_px)) GROUP BY image_id, inst_id, i) GROUP BY ALL""")
def _(t):
    from maskwright.sources.masks import start_lengths

    return start_lengths(t.gt_runs, 256).select("image_id", "inst_id", F.expr("array_join(counts, ',')").alias("counts"))


@query("m2_rle_round_trip", "SELECT image_id, inst_id, count(*) AS area, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM gt_px GROUP BY ALL")
def _(t):
    """Encode every mask to its compressed string and decode it again."""
    from maskwright.sources.masks import decode_rle, encode_rle

    back = decode_rle(encode_rle(t.gt_runs, 256, 256), 256, 256)
    return back.groupBy("image_id", "inst_id").agg(
        F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area"), F.sum(F.expr("cast(x1 - x0 as bigint) * (x0 + x1 - 1) div 2")).alias("sx"),
        F.sum(F.expr("cast(x1 - x0 as bigint) * y")).alias("sy"))
