"""Decision tables at their boundaries, splits, audit and readers on inline rows."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from maskwright.functions import policies as P
from maskwright.operators import dataset as D, numbering, review as V
from maskwright.plans import history
from maskwright.sources import readers as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("area,score,reason", [
    (199, 0.60, "pass_small"), (199, 0.59, "drop_small_score"), (200, 0.20, "pass_medium"), (599, 0.19, "drop_medium_score"), (600, 0.18, "pass_large"), (600, 0.17, "drop_large_score")])
def test_score_gate(spark, area, score, reason):
    assert one(spark, P.ScoreGate().decide(F.col("a"), F.col("s")), a=area, s=score).reason == reason


@pytest.mark.parametrize("dist,area,score,sol,asp,reason", [
    (0.029, 900, 1.0, 1.0, 1.0, "drop_hard_core"), (0.03, 600, 0.18, 0.90, 1.80, "rescue_soft_core"), (0.079, 599, 1.0, 1.0, 1.0, "drop_soft_core"), (0.08, 1, 0.0, 0.0, 9.0, "pass_outside_core")])
def test_core_policy(spark, dist, area, score, sol, asp, reason):
    v = P.CorePolicy().decide(F.col("d"), F.col("a"), F.col("s"), F.col("so"), F.col("asp"), 1000)
    assert one(spark, v, d=dist * 1000, a=area, s=score, so=sol, asp=asp).reason == reason


@pytest.mark.parametrize("dist,area,sol,asp,reason", [
    (29.0, 100, 1.0, 1.0, "prior_hard_center"), (30.0, 29, 1.0, 1.0, "prior_area_low"), (30.0, 30, 0.82, 1.0, "prior_solidity"), (30.0, 30, 0.83, 1.76, "prior_aspect"), (30.0, 30, 0.83, 1.75, "pass_prior_filter")])
def test_prior_filter(spark, dist, area, sol, asp, reason):
    v = P.PriorFilter().decide(F.col("a"), F.col("so"), F.col("asp"), F.col("d"), 1000)
    assert one(spark, v, d=dist, a=area, so=sol, asp=asp).reason == reason


@pytest.mark.parametrize("sid,ratio,area,sol,asp,decision,reason", [
    (None, 0.0, 1, 0.0, 9.0, "pass", "pass_no_stream_conflict"), (3, 0.90, 600, 0.90, 1.80, "win", "satellite_wins"), (3, 1.0, 599, 1.0, 1.0, "drop", "area_under_600_swallowed_by_stream"),
    (3, 1.0, 600, 0.89, 1.0, "drop", "not_compact_enough_to_win"), (3, 0.89, 600, 1.0, 1.0, "drop", "lost_to_stream_area_ge_600")])
def test_stream_conflict(spark, sid, ratio, area, sol, asp, decision, reason):
    v = P.StreamConflict().decide(F.col("i").cast("long"), F.col("r"), F.col("a"), F.col("so"), F.col("asp"))
    got = one(spark, v, i=sid, r=ratio, a=area, so=sol, asp=asp)
    assert (got.decision, got.reason) == (decision, reason)


@pytest.mark.parametrize("gt,pur,comp,ratio,one_one,label", [
    (None, 0.0, None, None, False, "reject_unmatched"), (1, 0.1, 0.95, 3.0, True, "compact_complete"), (1, 0.1, 0.95, 3.1, True, "reject_low_purity"),
    (1, 0.5, 0.5, 1.0, False, "compact_complete"), (1, 0.5, 0.49, 1.0, True, "diffuse_core")])
def test_taxonomy(spark, gt, pur, comp, ratio, one_one, label):
    v = P.Taxonomy().classify(F.col("g"), F.col("p"), F.col("c").cast("double"), F.col("r").cast("double"), F.col("o"))
    assert one(spark, v, g=gt, p=pur, c=comp, r=ratio, o=one_one).taxonomy_label == label


def test_unknown_label_fails(spark):
    with pytest.raises(Exception, match="unknown type_label"):
        one(spark, P.normalize_type_label(F.col("x")), x="galaxy")


def test_history_skips_and_relabels(spark):
    rows = [(1, 1, 0.9, 300, 1.0, 1.0, 5.0), (1, 2, 0.9, 300, 1.0, 1.0, 500.0), (1, 3, 0.1, 100, 1.0, 1.0, 500.0)]
    df = spark.createDataFrame(rows, "image_id long, inst_id long, score double, area long, solidity double, aspect_sym_moment double, dist_to_center double")
    h = {r.inst_id: r for r in history.candidate_history(df, 1000, prior=P.PriorFilter(hard_center_action="relabel_inner_galaxy"), core=None, conflict=None).collect()}
    assert [e.stage for e in h[1].history] == [*history.STAGES[:4], history.STAGES[6]] and h[1].final_status == "relabeled_inner_galaxy"
    assert [e.decision for e in h[2].history][4:] == ["skipped", "skipped", "pass"] and h[2].final_status == "kept"
    assert h[3].final_status == "dropped" and len(h[3].history) == 3
    assert set(h[2].history[0].metrics_snapshot_thin) == {"score", "area_clean_px", "solidity", "aspect_sym_moment", "dist_to_center_px", "dist_to_center_frac"}


def test_split_hash(spark):
    import hashlib

    got = {r.k: r.s for r in spark.range(200).select(F.col("id").alias("k"), D.split_side(F.col("id"), 0.8).alias("s")).collect()}
    for k, side in got.items():
        share = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert side == ("train" if share < 0.8 else "val")


def test_numbering_on_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"), F.xxhash64("id").alias("o"))
    got = numbering.number_rows(df, ["g"], [F.col("o")], "n").where("g = -1").orderBy("o").select("n").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))
    run = numbering.running_sums(df.withColumn("one", F.lit(1)), ["g"], [F.col("o")], {"c": "one"}).where("g = -1").orderBy("o").collect()
    assert [r.c for r in run] == list(range(1, len(run) + 1))


def test_audit_and_silver(spark):
    log = spark.createDataFrame([(1, "prepared", 5, None), (1, "committed", 5, None), (1, "failed", 9, None), (1, "committed", None, 7), (2, "failed", 3, None)],
                                "image_id long, status string, assigned_instance_id long, deleted_instance_id long")
    assert [(r.image_id, r.n_reserved, r.max_reserved_id) for r in V.audit_fold(log).collect()] == [(1, 2, 7)]
    bad = spark.createDataFrame([("satellite_mv", "accept"), ("satellite_ev", "accept")], "family string, label string")
    assert [r.family for r in V.invalid_labels(bad).collect()] == ["satellite_ev"]


def test_readers(spark, tmp_path):
    doc = {"predictions": [{"type_label": "satellites", "score": 0.5, "rle": {"size": [4, 4], "counts": "x"}, "raw_index": 3}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps(doc["predictions"]))
    assert [(r.raw_index, r.position) for r in S.read_predictions(spark, str(tmp_path / "*.json")).collect()] == [(3, 0), (3, 0)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    assert [r.line_no for r in S.malformed_lines(spark, str(tmp_path / "l.jsonl")).collect()] == [4]
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema).collect()
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate([
        "# Feature1 NGC1 Inner Galaxy", "polygon(1,2,3,4,5,6)", "polygon(1,2,3,4)", "# Feature2 NGC2 Cirrus", "line(1,2,3,4)", "# Feature3 NGC3 Shells", "line(1,2,x,4)", "# Feature4 NGC4 Tail", "global", "line(1,2,3,4)"])],
        "file string, line_no int, value string")
    assert [(r.feature_id, r.type, r.kind, len(r.verts)) for r in S.parse_regions(lines).orderBy("line_no").collect()] == [(1, "Inner", "polygon", 3), (4, "Tail", "line", 2)]
    fixed = spark.createDataFrame([("NGC1     10.5   -3.25",), ("short",)], "value string")
    assert [tuple(r) for r in S.read_fixed_width(fixed, [("name", 1, 8, "string"), ("ra", 10, 16, "double"), ("dec", 17, 24, "double")]).collect()] == [("NGC1", 10.5, -3.25)]


def fits_bytes(img):
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", "NAXIS   =                    2", f"NAXIS1  = {img.shape[1]:>20}", f"NAXIS2  = {img.shape[0]:>20}", "UNITS   = 'mag/arcsec^2'", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
    data = img.astype(">f4").tobytes()
    return head + data + b"\0" * (-len(data) % 2880)


def test_rasters(spark, tmp_path):
    img = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "m.fits.gz").write_bytes(gzip.compress(fits_bytes(img)))
    rows = S.read_photometric(spark, str(tmp_path / "m.fits.gz")).orderBy("y").collect()
    assert [list(r["values"]) for r in rows] == img.tolist() and rows[0].header["UNITS"] == "mag/arcsec^2"
    label = np.array([[0, 1, 1, 2], [2, 2, 0, 1], [0, 0, 0, 0]], np.int32)
    np.save(tmp_path / "l.npy", label)
    got = {tuple(r)[1:] for r in S.read_instance_maps(spark, str(tmp_path / "l.npy")).collect()}
    assert got == {(1, 0, 1, 3), (2, 0, 3, 4), (2, 1, 0, 2), (1, 1, 3, 4)}


def test_lines_are_numbered_over_byte_ranges(spark, tmp_path):
    """Files cut into many ranges: numbers follow the file, blank lines count."""
    for name, n in (("a.txt", 2000), ("b.txt", 3), ("c.txt", 0)):
        (tmp_path / name).write_text("".join("\n" if k % 10 == 9 else f"line {k + 1} {'x' * (k % 50)}\n" for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = S.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, n in (("a.txt", 2000), ("b.txt", 3)):
        own = {r.line_no: r.value for r in rows if r.file.endswith(name)}
        assert set(own) == set(range(1, n + 1))
        assert all(v == "" if k % 10 == 0 else v.startswith(f"line {k} ") for k, v in own.items())


def test_adopt_in_request_order(spark):
    """Runs 0-10, 5-13, 10-17 with at least 5 pixels: the second is too small after the first and takes
    nothing from the third. The same source twice: the second is a duplicate."""
    from maskwright.operators.replay import adopt

    source = "source_prediction_path string, source_candidate_id string, source_candidate_rle_sha1 string"
    requests = spark.createDataFrame(
        [(1, k, "satellites", f"p{k}", f"c{k}", f"h{k}") for k in (1, 2, 3)]
        + [(2, 1, "satellites", "p", "c", "h"), (2, 2, "satellites", "p", "c", "h"), (2, 3, "streams", "p", "c", "i"), (2, 4, "satellites", "p", "c", "k")],
        "image_id long, request_id long, type_label string, " + source)
    runs = spark.createDataFrame(
        [(1, 1, 0, 0, 10), (1, 2, 0, 5, 13), (1, 3, 0, 10, 17), (2, 1, 0, 0, 9), (2, 2, 5, 0, 9), (2, 3, 7, 0, 9), (2, 4, 0, 2, 9)],
        "image_id long, request_id long, y int, x0 int, x1 int")
    instances = spark.createDataFrame([], "image_id long, inst_id long, type_label string, " + source)
    state = spark.createDataFrame([], "image_id long, inst_id long, y int, x0 int, x1 int")
    log = spark.createDataFrame([], "image_id long, status string, assigned_instance_id long, deleted_instance_id long")
    done = adopt(requests, instances, state, runs, log, min_area=5)
    verdicts, new = done.verdicts, done.runs
    got = {(r.image_id, r.request_id): (r.outcome, r.assigned_instance_id, r.cropped_area_px) for r in verdicts.collect()}
    assert got == {(1, 1): ("adopted", 1, 10), (1, 2): ("area_too_small", None, 3), (1, 3): ("adopted", 2, 7),
                   (2, 1): ("adopted", 1, 9), (2, 2): ("duplicate", None, None), (2, 3): ("unsupported_type", None, None), (2, 4): ("empty_crop", None, 0)}
    assert sorted((r.image_id, r.inst_id, r.x0, r.x1) for r in new.collect()) == [(1, 1, 0, 10), (1, 2, 10, 17), (2, 1, 0, 9)]
    over = {(r.image_id, r.request_id): r.outcome for r in adopt(requests, instances, state, runs, log, min_area=5, id_limit=1).verdicts.collect()}
    assert over[1, 1] == "adopted" and over[1, 3] == "id_overflow"


def test_late_image_line_is_stale_before_all_else(spark):
    from maskwright.operators import review as V

    rows = [(1, 1, "satellite_mv", None, "authoritative", 5, True), (1, 2, "stream_ev", "drop_top1", "authoritative", 5, True)]
    lines = spark.createDataFrame(rows, "sample_id long, line_no long, task_family string, variant_id string, candidate_source string, inst_id long, is_current boolean")
    assert {r.line_no: r.refusal for r in V.import_outcomes(lines).collect()} == {1: None, 2: "stale_revision"}


def test_exact_quantiles(spark):
    import numpy as np

    from maskwright.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    rows = [(g, float(v), int(w)) for g, n in (("a", 1), ("b", 2), ("c", 500), (None, 37)) for v, w in zip(rng.integers(0, 60, n) / 7, rng.integers(1, 4, n))]
    df = spark.createDataFrame([*rows, ("d", None, 1)], "g string, v double, w int")
    for weight in (None, "w"):
        got = {r.g: (r.lo, r.mid, r.hi) for r in exact_quantiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.99}, weight).collect()}
        assert set(got) == {"a", "b", "c", None}
        for g, q in got.items():
            values = [v for h, v, w in rows for _ in range(w if weight else 1) if h == g]
            assert np.allclose(q, np.quantile(values, [0.05, 0.5, 0.99]))


def test_reserved_max_on_a_growing_log(spark, tmp_path):
    """The fold on a file stream, one file a batch, ends where the fold of all entries ends."""
    from maskwright.streaming.audit import reserved_max

    entries = [(i % 5, ("prepared", "committed", "failed")[i % 3], 10 + i if i % 2 else None, None if i % 2 else 200 - i) for i in range(60)]
    kind = "image_id long, status string, assigned_instance_id long, deleted_instance_id long"
    folder = str(tmp_path / "log")
    for at in range(0, 60, 20):
        spark.createDataFrame(entries[at:at + 20], kind).coalesce(1).write.mode("append").parquet(folder)
    stream = reserved_max(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("reserved_now").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in reserved_max(spark.createDataFrame(entries, kind)).collect()}
    assert {tuple(r) for r in spark.table("reserved_now").collect()} == want and want
