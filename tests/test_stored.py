"""Stored runs: generations, layers derived again only where they must be, refusals, empty layers."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import policies as P
from maskwright.plans.post import PostConfig
from maskwright.plans.stored import POST, RAW, Run, mask_digests, rebuild_post, report_from_stored, stage_traces, stored_masks

SIDE, ROI = 100, (0, 0, 100, 100)
CFG = PostConfig(sanity=None, gate=P.ScoreGate(10, 50, 0.6, 0.4, 0.3), prior=None, core=None, conflict=None)
OTHER = PostConfig(sanity=None, gate=None, prior=P.PriorFilter(30, 0.83, 1.75), core=None, conflict=None)


def box(image, inst, y, x, side, score):
    return (image, inst, "satellites", score, 0.95, 1.0, 1.0), [(image, inst, r, x, x + side) for r in range(y, y + side)]


def layer(spark, boxes):
    masks = spark.createDataFrame([b[0] for b in boxes], "image_id long, inst_id long, type_label string, score double, solidity double, aspect_sym_moment double, curvature_ratio double")
    runs = spark.createDataFrame([r for b in boxes for r in b[1]], "image_id long, inst_id long, y int, x0 int, x1 int")
    return stored_masks(masks, runs, RAW)


@pytest.fixture
def images(spark):
    return spark.createDataFrame([(1,), (2,), (3,)], "image_id long")


def test_only_changed_images_are_derived(spark, images, tmp_path):
    source, dest = Run(spark, str(tmp_path / "a")), Run(spark, str(tmp_path / "b"))
    boxes = [box(1, 1, 10, 10, 8, 0.9), box(1, 2, 50, 50, 8, 0.1), box(2, 1, 20, 20, 9, 0.7)]
    source.save(layer(spark, boxes), images, RAW)

    def rebuilt(cfg):
        return {r.image_id for r in rebuild_post(source, dest, cfg, SIDE).where("rebuilt").collect()}

    def kept():
        return {(r.image_id, r.inst_id) for r in dest.masks(POST).collect()}

    assert rebuilt(CFG) == {1, 2, 3} and kept() == {(1, 1), (2, 1)}
    assert rebuilt(CFG) == set()
    source.save(layer(spark, [box(2, 1, 20, 20, 9, 0.2), box(2, 5, 60, 20, 9, 0.9)]), images.where("image_id = 2"), RAW)
    assert rebuilt(CFG) == {2} and kept() == {(1, 1), (2, 5)}
    assert rebuilt(OTHER) == {1, 2, 3} and kept() == {(1, 1), (1, 2), (2, 1), (2, 5)}
    assert {(r.image_id, r.n_masks) for r in dest.layers().where(F.col("layer") == POST).collect()} == {(1, 2), (2, 2), (3, 0)}
    traces = {r.image_id: (r.n_raw_satellites, r.n_kept_post, r.agrees) for r in stage_traces(dest, OTHER, SIDE).collect()}
    assert traces == {1: (2, 2, True), 2: (2, 2, True)}


def test_a_source_is_not_overwritten(spark, images, tmp_path):
    run = Run(spark, str(tmp_path / "a"))
    run.save(layer(spark, [box(1, 1, 10, 10, 8, 0.9)]), images, RAW)
    with pytest.raises(RuntimeError, match="refusing"):
        rebuild_post(run, Run(spark, str(tmp_path / "a") + "/"), CFG, SIDE)
    raw = run.layers().where(F.col("layer") == RAW).collect()
    rebuild_post(run, run, CFG, SIDE, allow_inplace=True)
    assert sorted(run.layers().where(F.col("layer") == RAW).collect()) == sorted(raw) and run.masks(POST).count() == 1


def test_masks_without_an_entry_do_not_count(spark, images, tmp_path):
    """What a writer left behind that died before its last step is not read."""
    run = Run(spark, str(tmp_path / "a"))
    run.save(layer(spark, [box(1, 1, 10, 10, 8, 0.9)]), images, RAW)
    half = layer(spark, [box(1, 7, 10, 10, 8, 0.9)]).withColumn("generation", F.lit(9).cast("long"))
    half.select("image_id", "inst_id", "type_label", "score", "solidity", "aspect_sym_moment", "curvature_ratio", "runs", "generation", "layer").write.mode("append").partitionBy("layer").parquet(f"{run.root}/masks")
    assert [r.inst_id for r in run.masks(RAW).collect()] == [1]


def test_images_without_both_layers_are_skipped(spark, images, tmp_path):
    run = Run(spark, str(tmp_path / "a"))
    run.save(layer(spark, [box(1, 1, 10, 10, 8, 0.9)]), images, RAW)
    run.save(layer(spark, [box(1, 1, 10, 10, 8, 0.9)]).withColumn("layer", F.lit(POST)), images.where("image_id < 3"), POST)
    num_gt = images.select("image_id", F.explode(F.array(F.lit("full_frame"), F.lit("roi"))).alias("scope"), F.lit(0).cast("long").alias("num_gt"))
    gt = spark.createDataFrame([], "image_id long, inst_id long, type_label string, y int, x0 int, x1 int")
    rows, skipped = report_from_stored(run, gt, num_gt, ROI, SIDE)
    assert [r.image_id for r in skipped.collect()] == [3]
    assert {(r.image_id, r.layer, r.scope): r.num_pred for r in rows.collect()} == {
        (i, name, scope): int(i == 1) for i in (1, 2) for name in (RAW, POST) for scope in ("full_frame", "roi")}


def test_digest_follows_content(spark):
    one, two = [box(1, 1, 10, 10, 8, 0.9), box(1, 2, 50, 50, 8, 0.1)], [box(1, 2, 50, 50, 8, 0.1), box(1, 1, 10, 10, 8, 0.9)]
    digests = [mask_digests(layer(spark, b).repartition(3)).first().digest for b in (one, two, [one[0], box(1, 2, 50, 51, 8, 0.1)])]
    assert digests[0] == digests[1] != digests[2]
