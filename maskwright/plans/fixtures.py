"""Mask data derived from the given tables: boxes from line items, runs, scores, metrics.

``Tables`` builds the Spark side lazily; ``CTES`` states the same in SQL for the checks.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.operators import match, runs as R, shape
from maskwright.session import ROWS_PER_TASK, held, kept_once, size_shuffles

SIDE = 256
ROI = (32, 32, 224, 224)
CROWDED = 2_000  # masks; about 100 to a block, and a task has room for many such images
NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK):
        self.spark, self.dir, self.rows_per_task = spark, sf_dir, rows_per_task

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def boxes(self) -> DataFrame:
        """One row per (part, order, line); equal keys keep the smallest row.

        Each box later becomes a dozen run rows, so the number of tasks is set here for the
        exploded data and grows with the table, which keeps what one task sorts in memory; adaptive
        coalescing would size it for the small boxes. All later aggregations, windows and joins by image
        find their rows together, so the boxes are all that is shuffled. Where an image is too crowded for
        that, only masks are kept together and each later step spreads the image by its own keys.
        """
        lines = self.lineitem.groupBy("l_partkey").count().agg(F.sum("count"), F.max("count")).first()
        tasks = max(size_shuffles(self.spark, lines[0] or 0, self.rows_per_task), self.spark.sparkContext.defaultParallelism)
        keyed = self.lineitem.withColumn("image_id", F.col("l_partkey").cast("long")).withColumn(
            "inst_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long"))
        crowded = (lines[1] or 0) > CROWDED
        together = ["image_id", "inst_id"] if crowded else ["image_id"]
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(crowded).lower())
        first = keyed.repartition(tasks, *together).groupBy("image_id", "inst_id").agg(F.min(F.struct(
            "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey",
        )).alias("r"))
        return kept_once(first.select(
            "image_id", "inst_id",
            F.expr("cast(r.l_orderkey as bigint)").alias("ok"),
            F.expr("cast(r.l_quantity as bigint)").alias("q"),
            F.expr("cast(round(r.l_discount * 100) as bigint)").alias("d"),
            F.expr("cast(round(r.l_tax * 100) as bigint)").alias("t"),
            F.expr("r.l_returnflag").alias("flag"),
            F.expr("case when r.l_linestatus = 'F' then 'satellites' else 'tidal_features' end").alias("type_label"),
        ))

    @cached_property
    def images(self) -> DataFrame:
        return self.boxes.select("image_id").distinct()

    @cached_property
    def gt(self) -> DataFrame:
        return self.boxes.where("flag <> 'N'").selectExpr(
            "image_id", "inst_id", "type_label",
            "cast((ok * 37 + q * 11) % 240 as int) as y0", "cast((ok * 53 + q * 7) % 240 as int) as x0",
            "cast(6 + q % 11 as int) as h", "cast(6 + (q * 3) % 13 as int) as w",
        ).selectExpr("image_id", "inst_id", "type_label", "y0", f"least(y0 + h, {SIDE}) as y1",
                     "x0", f"least(x0 + w, {SIDE}) as x1")

    @cached_property
    def pred(self) -> DataFrame:
        """Boxes of predictions with score and stored shape figures."""
        return self.boxes.where("d >= 2").selectExpr(
            "image_id", "inst_id", "type_label",
            "cast((ok * 37 + q * 11) % 240 + d % 5 - 2 as int) as y", "cast((ok * 53 + q * 7) % 240 + t % 4 - 1 as int) as x",
            "cast(6 + q % 11 + d % 3 as int) as h", "cast(6 + (q * 3) % 13 + t % 3 as int) as w",
            "d / double(10) as score",
            "(70 + (q * 3) % 31) / double(100) as solidity",
            "(100 + (q * 7 + t * 13) % 120) / double(100) as aspect_sym_moment",
            "(80 + (q * 5 + d * 11) % 90) / double(100) as curvature_ratio",
            "(q % 10) / double(10) as stability_score",
            "element_at(array('kept', 'kept', 'kept', 'prior_rejected', 'core_rejected'), cast(q % 5 + 1 as int)) as filter_status",
        ).selectExpr(
            "image_id", "inst_id", "type_label",
            "greatest(y, 0) as y0", f"least(y + h, {SIDE}) as y1", "greatest(x, 0) as x0", f"least(x + w, {SIDE}) as x1",
            "score", "solidity", "aspect_sym_moment", "curvature_ratio", "stability_score", "filter_status",
        )

    @staticmethod
    def jag(boxes: DataFrame, keep: list[str]) -> DataFrame:
        """Rows of a box with ragged ends, so that masks are not rectangles."""
        rows = R.box_runs(boxes, keep)
        return rows.withColumn("x0", F.expr("cast(x0 + y % 3 as int)")).withColumn("x1", F.expr("cast(x1 - (y * 7) % 2 as int)"))

    @cached_property
    def gt_runs(self) -> DataFrame:
        return self.jag(self.gt, ["image_id", "inst_id", "type_label"])

    @cached_property
    def pred_runs(self) -> DataFrame:
        return self.jag(self.pred, ["image_id", "inst_id", "type_label"])

    def gt_of(self, label: str) -> DataFrame:
        return self.gt_runs.where(F.col("type_label") == label)

    def pred_of(self, label: str) -> DataFrame:
        return self.pred_runs.where(F.col("type_label") == label)

    def measured(self, pred: DataFrame) -> DataFrame:
        """Predictions with area, centroid and distance. The runs keep the partitioning of the
        boxes, so neither the aggregation nor the join moves them."""
        runs = self.jag(pred, R.MASK)
        m = shape.centroids(shape.moments(runs)).select(*R.MASK, "area", "cx", "cy")
        m = m.withColumn("dist_to_center", shape.dist_to_center(F.col("cx"), F.col("cy"), SIDE, SIDE))
        return pred.drop("y0", "y1", "x0", "x1").join(m, R.MASK)

    @cached_property
    def pred_m(self) -> DataFrame:
        return self.measured(self.pred)

    @cached_property
    def gt_m(self) -> DataFrame:
        m = shape.centroids(shape.moments(self.gt_runs)).select(*R.MASK, "area", "cx", "cy")
        return self.gt.select(*R.MASK, "type_label").join(m, R.MASK)

    @cached_property
    def sat_pairs(self) -> DataFrame:
        return held(match.overlap_pairs(self.pred_of("satellites"), self.gt_of("satellites")))

    @cached_property
    def sat_hits(self) -> DataFrame:
        """Shared pixels of satellite pairs with the area of the ground truth only."""
        return held(match.hits(self.pred_of("satellites"), self.gt_of("satellites")))

    @cached_property
    def sats(self) -> DataFrame:
        return self.measured(self.pred.where("type_label = 'satellites'"))

    @cached_property
    def candidates(self) -> DataFrame:
        """Classified raw satellite predictions."""
        sats = self.sats.withColumn("raw_index", F.col("inst_id"))
        return match.classify_candidates(self.sat_hits, sats, roi=ROI)


# The same tables in SQL. Pixels are spelled out, so the check does not share the run algebra.
CTES = {
    "boxes": """
        SELECT CAST(l_partkey AS BIGINT) AS image_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS inst_id,
               CAST(l_orderkey AS BIGINT) AS ok, CAST(l_quantity AS BIGINT) AS q,
               CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t,
               l_returnflag AS flag,
               CASE WHEN l_linestatus = 'F' THEN 'satellites' ELSE 'tidal_features' END AS type_label
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey, l_orderkey * 10 + l_linenumber
            ORDER BY l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1""",
    "images": "SELECT DISTINCT image_id FROM boxes",
    "gt": """
        SELECT image_id, inst_id, type_label, y0, least(y0 + h, 256) AS y1, x0, least(x0 + w, 256) AS x1 FROM (
          SELECT image_id, inst_id, type_label, (ok * 37 + q * 11) % 240 AS y0, (ok * 53 + q * 7) % 240 AS x0,
                 6 + q % 11 AS h, 6 + (q * 3) % 13 AS w FROM boxes WHERE flag <> 'N')""",
    "pred": """
        SELECT image_id, inst_id, type_label, greatest(y, 0) AS y0, least(y + h, 256) AS y1,
               greatest(x, 0) AS x0, least(x + w, 256) AS x1,
               score, solidity, aspect_sym_moment, curvature_ratio, stability_score, filter_status FROM (
          SELECT image_id, inst_id, type_label,
                 (ok * 37 + q * 11) % 240 + d % 5 - 2 AS y, (ok * 53 + q * 7) % 240 + t % 4 - 1 AS x,
                 6 + q % 11 + d % 3 AS h, 6 + (q * 3) % 13 + t % 3 AS w,
                 d / CAST(10 AS DOUBLE) AS score,
                 (70 + (q * 3) % 31) / CAST(100 AS DOUBLE) AS solidity,
                 (100 + (q * 7 + t * 13) % 120) / CAST(100 AS DOUBLE) AS aspect_sym_moment,
                 (80 + (q * 5 + d * 11) % 90) / CAST(100 AS DOUBLE) AS curvature_ratio,
                 (q % 10) / CAST(10 AS DOUBLE) AS stability_score,
                 (['kept', 'kept', 'kept', 'prior_rejected', 'core_rejected'])[q % 5 + 1] AS filter_status
          FROM boxes WHERE d >= 2)""",
    "gt_runs": """
        SELECT image_id, inst_id, type_label, y, x0 + y % 3 AS x0, x1 - (y * 7) % 2 AS x1
        FROM (SELECT *, unnest(range(y0, y1)) AS y FROM gt)""",
    "pred_runs": """
        SELECT image_id, inst_id, type_label, y, x0 + y % 3 AS x0, x1 - (y * 7) % 2 AS x1
        FROM (SELECT *, unnest(range(y0, y1)) AS y FROM pred)""",
    "gt_px": "SELECT image_id, inst_id, type_label, y, unnest(range(x0, x1)) AS x FROM gt_runs",
    "pred_px": "SELECT image_id, inst_id, type_label, y, unnest(range(x0, x1)) AS x FROM pred_runs",
    "pred_m": """
        SELECT p.* EXCLUDE (y0, y1, x0, x1), m.area, m.cx, m.cy,
               sqrt((m.cx - 128) * (m.cx - 128) + (m.cy - 128) * (m.cy - 128)) AS dist_to_center
        FROM pred p JOIN (SELECT image_id, inst_id, count(*) AS area,
               CAST(sum(x) AS DOUBLE) / count(*) AS cx, CAST(sum(y) AS DOUBLE) / count(*) AS cy
             FROM pred_px GROUP BY ALL) m USING (image_id, inst_id)""",
    "gt_m": """
        SELECT image_id, inst_id, type_label, count(*) AS area,
               CAST(sum(x) AS DOUBLE) / count(*) AS cx, CAST(sum(y) AS DOUBLE) / count(*) AS cy
        FROM gt_px GROUP BY ALL""",
    "all_pairs": """
        SELECT p.image_id, p.inst_id AS pred_id, g.inst_id AS gt_id, p.type_label AS pred_type, g.type_label AS gt_type,
               CAST(sum(least(p.x1, g.x1) - greatest(p.x0, g.x0)) AS BIGINT) AS inter
        FROM pred_runs p JOIN gt_runs g ON p.image_id = g.image_id AND p.y = g.y AND p.x0 < g.x1 AND g.x0 < p.x1
        GROUP BY ALL""",
    "pairs": """
        SELECT a.*, p.area AS pred_area, g.area AS gt_area, p.area + g.area - inter AS union_px,
               CAST(inter AS DOUBLE) / (p.area + g.area - inter) AS iou
        FROM all_pairs a JOIN pred_m p ON a.image_id = p.image_id AND a.pred_id = p.inst_id
        JOIN gt_m g ON a.image_id = g.image_id AND a.gt_id = g.inst_id""",
    "sat_pairs": "SELECT * FROM pairs WHERE pred_type = 'satellites' AND gt_type = 'satellites'",
    "primary_m": """
        SELECT p.*, b.gt_id AS matched_gt_id, coalesce(b.inter, 0) AS overlap_px, b.gt_area AS matched_gt_area
        FROM (SELECT * FROM pred_m WHERE type_label = 'satellites') p LEFT JOIN (
          SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY inter DESC, gt_id) AS rn FROM sat_pairs) b
        ON p.image_id = b.image_id AND p.inst_id = b.pred_id AND b.rn = 1""",
    "one2one": """
        SELECT *, matched_gt_id IS NOT NULL AND row_number() OVER (PARTITION BY image_id, matched_gt_id
                    ORDER BY overlap_px DESC, inst_id) = 1 AS is_one_to_one,
               CAST(overlap_px AS DOUBLE) / area AS purity,
               CAST(overlap_px AS DOUBLE) / matched_gt_area AS completeness,
               CAST(area AS DOUBLE) / matched_gt_area AS seed_gt_ratio,
               cy >= 32 AND cy < 224 AND cx >= 32 AND cx < 224 AS intersects_roi
        FROM primary_m""",
    "candidates": """
        SELECT *, CASE WHEN matched_gt_id IS NULL THEN 'reject_unmatched'
                 WHEN completeness >= 0.95::DOUBLE AND is_one_to_one AND seed_gt_ratio <= 3 THEN 'compact_complete'
                 WHEN purity < 0.5::DOUBLE THEN 'reject_low_purity'
                 WHEN completeness >= 0.5::DOUBLE THEN 'compact_complete' ELSE 'diffuse_core' END AS taxonomy_label,
               CASE WHEN matched_gt_id IS NULL THEN 'no_gt_overlap'
                 WHEN completeness >= 0.95::DOUBLE AND is_one_to_one AND seed_gt_ratio <= 3 THEN 'one_to_one_complete_seed_ratio_ok'
                 WHEN purity < 0.5::DOUBLE THEN 'mixed_coverage'
                 WHEN completeness >= 0.5::DOUBLE THEN 'pure_and_complete' ELSE 'pure_but_core_only' END AS label_reason
        FROM one2one""",
    "num_gt": """
        SELECT i.image_id, count(g.inst_id) AS num_gt,
               count(g.inst_id) FILTER (cy >= 32 AND cy < 224 AND cx >= 32 AND cx < 224) AS num_gt_roi
        FROM images i LEFT JOIN (SELECT * FROM gt_m WHERE type_label = 'satellites') g USING (image_id) GROUP BY ALL""",
}


def with_ctes(body: str, doubles: str = "", ctes: dict[str, str] | None = None) -> str:
    """Prefix a query with the tables it names; round the listed double columns to nine digits."""
    known = {**CTES, **(ctes or {})}
    order = list(known)
    need: set[str] = set()
    sorted_: list[str] = []  # what a table reads stands before it

    def visit(text: str) -> None:
        for name in order:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(known[name])
                sorted_.append(name)

    visit(body)
    head = ", ".join(f"{n} AS ({known[n]})" for n in sorted_)
    if doubles:
        swap = ", ".join(f"round({c}, 9) + 0.0::DOUBLE AS {c}" for c in doubles.split())
        body = f"SELECT * REPLACE ({swap}) FROM ({body})"
    again = any(re.search(rf"\b{n}\b", known[n]) for n in need)  # a table that reads itself
    return f"WITH {'RECURSIVE ' * again}{head} {body}" if head else body
