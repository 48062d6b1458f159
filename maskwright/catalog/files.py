"""Named queries: files written from the tables and read back. Every query has a folder of its own in the shared one."""

import uuid

from pyspark.sql import functions as F, types as T

from maskwright.catalog import query
from maskwright.catalog.data import COCO, anns, imgs
from maskwright.operators import runs as R
from maskwright.plans.fixtures import SIDE
from maskwright.session import ensure_checkpoint_dir
from maskwright.sources import readers, writers


def folder(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/files-{name}-{uuid.uuid4().hex}"


@query("s3_prediction_lines", """
    SELECT row_number() OVER (PARTITION BY image_id ORDER BY inst_id) - 1 AS raw_index,
      CASE type_label WHEN 'satellites' THEN 'sat' ELSE 'tidal_fe' END || printf('_%04d', row_number() OVER (PARTITION BY image_id, type_label ORDER BY inst_id) - 1) AS candidate_id,
      type_label, score, area, solidity, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) - 1 AS position FROM pred_m""", doubles="score solidity")
def _(t):
    """Documents of all images, one a line, as candidates."""
    from maskwright.operators.dataset import assign_stable_ids
    from maskwright.sources.masks import encode_rle

    key = ["image_id", "inst_id"]
    box = R.bboxes(t.pred_runs).withColumnsRenamed({"bbox_w": "bbox_w_px", "bbox_h": "bbox_h_px"})
    m = t.pred_m.join(encode_rle(t.pred_runs, SIDE, SIDE).select(*key, "counts"), key).join(box, key)
    path = folder(t, "predictions")
    writers.write_documents(writers.prediction_documents(assign_stable_ids(m, [F.col("inst_id")]), SIDE, SIDE), path)
    out = readers.read_predictions(t.spark, f"{path}/layer=raw", per_line=True)
    return out.select("raw_index", "candidate_id", "type_label", "score", "area", "solidity", F.col("position").cast("long").alias("position"))


@query("s5_list_documents", "SELECT image_id, inst_id, type_label FROM gt")
def _(t):
    """Instance lists, one document a line."""
    lists = t.gt.groupBy("image_id").agg(F.to_json(F.collect_list(F.struct("image_id", "inst_id", "type_label"))).alias("value"))
    path = folder(t, "lists")
    lists.select("value").write.text(path)
    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("inst_id", T.LongType()), T.StructField("type_label", T.StringType())])
    return readers.read_list_documents(t.spark, path, schema, per_line=True).drop("file")


@query("s6_coco_lines", "SELECT image_id, i.width, line, category_id, area FROM anns a JOIN imgs i ON i.id = a.image_id", ctes=COCO)
def _(t):
    """A COCO data set written as lines and read back as its tables."""
    path = folder(t, "coco")
    images = imgs(t).select("id", F.lit(256).cast("long").alias("width"))
    writers.coco_lines(images, anns(t).select("image_id", "line", "category_id", "area")).write.text(path)
    image = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "width")])
    annotation = T.StructType([T.StructField(n, T.LongType()) for n in ("line", "category_id", "area")])
    i, a = readers.read_coco_lines(t.spark, path, image, annotation)
    return a.join(i.withColumnRenamed("id", "image_id"), "image_id")


@query("s7_json_lines", "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations")
def _(t):
    path = folder(t, "lines")
    writers.write_jsonl(t.conversations.select("conv_id", "turn", "role", "text"), path)
    return readers.read_jsonl(t.spark, path, t.conversations.select("conv_id", "turn", "role", "text").schema).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


@query("s7_malformed_lines", """
    SELECT count(*) AS n_lines, count(*) FILTER (turn % 3 = 1) AS n_bad, count(*) FILTER (turn % 3 = 2) AS n_blank, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_gaps FROM conversations""")
def _(t):
    """Broken lines among others, found by number: each number must lead to a broken line, and numbers have no gaps."""
    path = folder(t, "broken")
    line = F.to_json(F.struct("conv_id", "turn", "role"))
    t.conversations.select(F.when(F.col("turn") % 3 == 1, F.concat(F.lit('{"broken": '), line)).when(F.col("turn") % 3 == 2, "").otherwise(line).alias("value")).write.text(path)
    lines, bad = readers.numbered_lines(t.spark, path), readers.malformed_lines(t.spark, path)
    wrong = bad.join(lines, ["file", "line_no"], "left").agg(F.count(F.lit(1)).alias("n_bad"), F.count_if(~F.coalesce(F.col("value").startswith('{"broken"'), F.lit(False))).alias("n_misplaced"))
    per_file = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("top"), F.count_distinct("line_no").alias("d"), F.count_if(F.col("value") == "").alias("b"))
    whole = per_file.agg(F.sum("n").alias("n_lines"), F.sum("b").alias("n_blank"), F.sum(2 * F.col("n") - F.col("top") - F.col("d")).alias("n_gaps"))
    return whole.crossJoin(wrong).select("n_lines", "n_bad", "n_blank", "n_misplaced", "n_gaps")


@query("s8_csv_table", """
    SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note FROM orders""", doubles="price")
def _(t):
    """NULL and NaN are blank in the file."""
    path, k = folder(t, "csv"), F.col("o_orderkey")
    price = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 != 0, F.col("o_totalprice"))
    rows = t.orders.select(k.cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), price.alias("price"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("note"))
    writers.write_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).option("mode", "FAILFAST").csv(path)


@query("s11_fixed_width", "SELECT c_custkey::BIGINT AS key, c_nationkey::BIGINT AS nation, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey % 9 <> 0", doubles="balance")
def _(t):
    """Columns by byte places; rows with an unreadable number are left out."""
    path = folder(t, "fixed")
    balance = F.when(F.col("c_custkey") % 9 == 0, F.lit("n/a")).otherwise(F.format_string("%.2f", F.col("c_acctbal").cast("double")))
    t.customer.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, " "), F.lit(" "), F.lpad(F.col("c_nationkey").cast("string"), 4, " "), F.lpad(balance, 16, " ")).alias("value")).write.text(path)
    return readers.read_fixed_width(t.spark.read.text(path), [("key", 1, 12, "bigint"), ("nation", 14, 17, "bigint"), ("balance", 18, 33, "double")])


@query("s16_artifact_manifest", """
    SELECT part, sum(octet_length(encode(v)) + 1)::BIGINT AS length, sha256(string_agg(v || chr(10), '' ORDER BY v)) AS sha256, sha1(string_agg(v || chr(10), '' ORDER BY v)) AS sha1
    FROM (SELECT o_orderkey % 16 AS part, lpad(o_orderkey::VARCHAR, 12, '0') || '|' || o_orderstatus AS v FROM orders) GROUP BY part""")
def _(t):
    """Length and digests of files that hold known lines."""
    path = folder(t, "artifacts")
    rows = t.orders.select((F.col("o_orderkey") % 16).alias("part"), F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("|"), "o_orderstatus").alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "value").write.partitionBy("part").text(path)
    out = readers.artifact_manifest(t.spark, path)
    return out.select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), "length", "sha256", "sha1")


@query("s18_buckets", """
    SELECT CASE filter_status WHEN 'kept' THEN CASE WHEN score < 0.5::DOUBLE THEN 'ambiguous' ELSE 'kept' END ELSE filter_status END AS bucket, count(*) AS n, sum(area)::BIGINT AS area FROM pred_m GROUP BY ALL""")
def _(t):
    path = folder(t, "buckets")
    bucket = F.when((F.col("filter_status") == "kept") & (F.col("score") < 0.5), "ambiguous").otherwise(F.col("filter_status"))
    writers.write_buckets(t.pred_m.withColumn("bucket", bucket), path)
    return t.spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
