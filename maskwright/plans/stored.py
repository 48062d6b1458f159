"""Stored evaluation runs: layers of predicted masks on disk, reports made from them, layers derived again from the raw one.

A run is a folder with two tables. ``masks`` holds one row per mask and generation; ``layers`` one row per image,
layer and generation, with the digest of the masks and of what they were derived from. A generation counts once its
``layers`` rows are written, which happens last, and the newest one of an image and layer is valid. So a layer that is
derived again appends only the images whose digest has changed, and readers never see half of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.operators import match, score, shape
from maskwright.plans import history
from maskwright.plans.post import PostConfig, post_pred_only
from maskwright.session import by_image, cut, held

RAW, POST = "raw", "post_pred_only"
#: Figures that are stored with a mask; area, centroid and distance are measured again from its runs.
FIGURES = ("score", "solidity", "aspect_sym_moment", "curvature_ratio")
_KEY = ["image_id", "layer"]


def stored_masks(masks: DataFrame, runs: DataFrame, layer: str) -> DataFrame:
    """Rows as a run stores them: ``masks`` (image_id, inst_id, type_label, figures) with their runs as an ordered array."""
    arrays = runs.groupBy("image_id", "inst_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")]))).alias("runs"))
    return masks.select("image_id", F.lit(layer).alias("layer"), "inst_id", "type_label", *FIGURES).join(arrays, ["image_id", "inst_id"], "left")


def mask_digests(rows: DataFrame) -> DataFrame:
    """``image_id, layer, n_masks, digest`` of stored rows. Masks are hashed one by one; an image collects one digest a mask."""
    line = F.sha2(F.concat_ws("|", "inst_id", "type_label", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIGURES], F.to_json("runs")), 256)
    each = by_image(rows.select(*_KEY, F.struct("inst_id", F.unhex(line).alias("h")).alias("m")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: F.lower(F.hex(m["h"]))), "\n")
    return each.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_masks"), F.sha2(joined, 256).alias("digest"))


@dataclass(frozen=True)
class Run:
    """A run in the folder ``root``."""

    spark: SparkSession
    root: str

    def layers(self) -> DataFrame:
        """The valid row of every image and layer."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/layers")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "image_id long, layer string, generation long, n_masks long, digest string, derived_from string")
        newest = F.max_by(F.struct("generation", "n_masks", "digest", "derived_from"), "generation").alias("n")
        return by_image(rows).groupBy(*_KEY).agg(newest).select(*_KEY, "n.*")

    def masks(self, layer: str) -> DataFrame:
        """Valid stored rows of a layer; a run without masks is an empty table's error, not an empty layer."""
        valid = self.layers().where(F.col("layer") == layer).select(*_KEY, "generation")
        rows = self.spark.read.parquet(f"{self.root}/masks").where(F.col("layer") == layer)
        rows = rows.join(F.broadcast(valid.select("generation").distinct()), "generation", "left_semi").select(*rows.columns)  # one row a generation
        lists = [f"_{c}" for c in ("y", "x0", "x1")]  # a third of the bytes of the structs when they are moved
        flat = by_image(rows.withColumns({n: F.col(f"runs.{n[1:]}") for n in lists}).drop("runs"))
        zipped = F.transform(F.arrays_zip(*lists), lambda r: F.struct(*[r[n].alias(n[1:]) for n in lists]))
        return flat.withColumn("runs", zipped).select(*rows.columns).join(valid, [*_KEY, "generation"], "left_semi")

    def save(self, rows: DataFrame, images: DataFrame, layer: str, derived_from: DataFrame | None = None) -> None:
        """Append a generation of ``layer`` for ``images``: those without rows get an empty layer.

        ``derived_from``: image_id, derived_from. The masks are written first, the entries in ``layers`` last.
        """
        last = self.layers().agg(F.max("generation")).first()[0]
        generation = F.lit((last or 0) + 1).cast("long").alias("generation")
        rows.select("image_id", "inst_id", "type_label", *FIGURES, "runs", generation, "layer").write.mode("append").partitionBy("layer").parquet(f"{self.root}/masks")
        mine = self.spark.read.parquet(f"{self.root}/masks").where((F.col("layer") == layer) & (F.col("generation") == generation))
        entry = images.select("image_id", F.lit(layer).alias("layer")).join(mask_digests(mine), _KEY, "left")
        entry = entry.join(derived_from, "image_id", "left") if derived_from is not None else entry.withColumn("derived_from", F.lit(None).cast("string"))
        none = F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest")
        entry.select(*_KEY, generation, F.coalesce("n_masks", F.lit(0)).cast("long").alias("n_masks"), none, "derived_from").write.mode("append").parquet(f"{self.root}/layers")


def expanded(rows: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Masks of stored rows with measured figures, and their runs."""
    rows = rows.drop("layer", "generation")
    runs = rows.select("image_id", "inst_id", "type_label", F.explode("runs").alias("r")).select("image_id", "inst_id", "type_label", "r.*")
    m = shape.centroids(shape.moments(runs)).select("image_id", "inst_id", "area", "cx", "cy")
    masks = rows.drop("runs").join(m, ["image_id", "inst_id"]).withColumn("dist_to_center", shape.dist_to_center(F.col("cx"), F.col("cy"), side, side))
    return masks, runs


def satellite_blocks(masks: DataFrame, runs: DataFrame, gt_runs: DataFrame, num_gt: DataFrame, roi) -> DataFrame:
    """Taxonomy block of every image and scope from the satellites of one layer."""
    sats = masks.where("type_label = 'satellites'").withColumn("raw_index", F.col("inst_id"))
    found = held(match.hits(runs.where("type_label = 'satellites'"), gt_runs.where("type_label = 'satellites'")))
    candidates = match.classify_candidates(found, sats, roi=roi)
    scopes = F.when(F.col("intersects_roi"), F.array(F.lit("full_frame"), F.lit("roi"))).otherwise(F.array(F.lit("full_frame")))
    return score.taxonomy_block(candidates.withColumn("scope", F.explode(scopes)), num_gt, keys=("image_id", "scope"))


def report_rows(raw: tuple[DataFrame, DataFrame], post: tuple[DataFrame, DataFrame], gt_runs: DataFrame, num_gt: DataFrame, roi) -> DataFrame:
    """The report as rows (image_id, layer, scope): the block with the total of ground truths and the number of
    candidates of the image in either layer. ``raw`` and ``post`` are (masks, runs) of a layer."""
    totals = num_gt.where("scope = 'full_frame'").select("image_id", F.col("num_gt").alias("num_gt_satellites"))
    blocks = [satellite_blocks(*layer, gt_runs, num_gt, roi).withColumn("layer", F.lit(name)) for name, layer in ((RAW, raw), (POST, post))]
    rows = blocks[0].unionByName(blocks[1]).join(totals, "image_id")
    for name, (masks, _) in (("n_candidates", raw), ("n_post_candidates", post)):
        n = masks.where("type_label = 'satellites'").groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(n, "image_id", "left").na.fill(0, [name])
    return rows


def fresh_report(masks: DataFrame, runs: DataFrame, cfg: PostConfig, gt_runs: DataFrame, num_gt: DataFrame, roi, side: int, stream_label: str = "streams") -> DataFrame:
    """Report of predictions at hand. ``masks`` has the figures of ``expanded``."""
    kept, _ = post_pred_only(masks, runs, cfg, side, side, stream_label)
    kept = held(kept)
    post_masks, post_runs = expanded(stored_masks(masks.join(kept.select("image_id", "inst_id").distinct(), ["image_id", "inst_id"], "left_semi"), kept, POST), side)
    return report_rows((masks, runs), (post_masks, post_runs), gt_runs, num_gt, roi)


def report_from_stored(run: Run, gt_runs: DataFrame, num_gt: DataFrame, roi, side: int) -> tuple[DataFrame, DataFrame]:
    """Report of the stored layers, nothing derived again, and the images that are skipped since one layer is missing."""
    there = run.layers().groupBy("image_id").agg(F.collect_set("layer").alias("l"))
    whole = cut(there.where(F.array_contains("l", RAW) & F.array_contains("l", POST)).select("image_id"))
    layers = [expanded(held(run.masks(name).join(whole, "image_id", "left_semi")), side) for name in (RAW, POST)]
    rows = report_rows(*layers, gt_runs, num_gt.join(whole, "image_id", "left_semi"), roi)
    return rows, num_gt.select("image_id").distinct().join(whole, "image_id", "left_anti")


def rebuild_post(source: Run, dest: Run, cfg: PostConfig, side: int, stream_label: str = "streams", allow_inplace: bool = False) -> DataFrame:
    """Derive the post layer of ``source``'s raw masks into ``dest``; returns ``image_id, rebuilt`` of every raw image.

    What a post layer comes from is the digest of the image's raw masks with the text of ``cfg``; images whose
    layer in ``dest`` comes from the same are left alone. The raw layer is copied where it differs. Writing into the
    source is refused unless ``allow_inplace``, and adds a generation of the post layer only.
    """
    inplace = source.root.rstrip("/") == dest.root.rstrip("/")
    if inplace and not allow_inplace:
        raise RuntimeError("refusing to derive layers into their own source; name another folder or allow it")
    raw = source.layers().where(F.col("layer") == RAW)
    origin = raw.select("image_id", "digest", F.sha2(F.concat_ws("|", "digest", F.lit(f"{cfg}|{side}|{stream_label}")), 256).alias("derived_from"))
    have = dest.layers()
    old = have.where(F.col("layer") == POST).select("image_id", F.col("derived_from").alias("_old"))
    plan = cut(origin.join(old, "image_id", "left").select("image_id", "digest", "derived_from", F.coalesce(F.col("_old") != F.col("derived_from"), F.lit(True)).alias("rebuilt")))
    todo = plan.where("rebuilt").select("image_id", "derived_from")
    needed = todo.select("image_id")
    if not inplace:
        copied = have.where(F.col("layer") == RAW).select("image_id", F.col("digest").alias("_copied"))
        stale = cut(plan.join(copied, "image_id", "left").where("_copied IS NULL OR _copied <> digest").select("image_id"))
        if not stale.isEmpty():
            needed = needed.union(stale).distinct()
    if not needed.isEmpty():
        rows = held(source.masks(RAW).join(needed, "image_id", "left_semi"))
    if not inplace and not stale.isEmpty():
        dest.save(rows.join(stale, "image_id", "left_semi"), stale, RAW)
    if not todo.isEmpty():
        masks, runs = expanded(rows.join(todo, "image_id", "left_semi"), side)
        kept, _ = post_pred_only(masks, runs.drop("type_label"), cfg, side, side, stream_label)
        kept = held(kept)
        left = masks.join(kept.select("image_id", "inst_id").distinct(), ["image_id", "inst_id"], "left_semi")
        dest.save(stored_masks(left, kept, POST), todo.select("image_id"), POST, todo)
    return plan.select("image_id", "rebuilt")


def stage_traces(run: Run, cfg: PostConfig, side: int) -> DataFrame:
    """Stages of every raw satellite of a run beside what its post layer kept; ``agrees`` must hold for all images."""
    masks, _ = expanded(run.masks(RAW), side)
    trace = history.satellite_trace(masks.where("type_label = 'satellites'"), side, cfg.gate, cfg.prior, cfg.core)
    kept = run.masks(POST).where("type_label = 'satellites'").groupBy("image_id").agg(F.count(F.lit(1)).alias("n_post"))
    per = trace.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_raw_satellites"), F.count_if(F.col("final_status") == "kept").alias("n_kept_post"))
    per = per.join(kept, "image_id", "left").na.fill(0, ["n_post"])
    return per.select("image_id", "n_raw_satellites", "n_kept_post", (F.col("n_raw_satellites") - F.col("n_kept_post")).alias("n_removed_post"), (F.col("n_kept_post") == F.col("n_post")).alias("agrees"))
