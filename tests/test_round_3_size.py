"""Size of one task in queries whose branches move nothing between them (findings of round 3)."""

import pytest

from maskwright.catalog import load

MB = 1 << 20


def _stages(spark):
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}


def _run(spark, name, sf_dir="/root/testdata/sf0.001"):
    """Stages of a query that joins without broadcasts, as it does on large tables."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = set(_stages(spark))
    for n in names:
        spark.conf.set(n, "-1")
    try:
        load()[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    finally:
        for n in names:
            spark.conf.unset(n)
    return [s for k, s in _stages(spark).items() if k not in before and s.numCompleteTasks()]


@pytest.mark.parametrize("name, limit", [("e10_exhaustivity", 2500), ("a15_average_precision", 1000), ("a9_report_stored", 2500)])
def test_memory_of_one_task(spark, name, limit):
    """Each sort and hash table takes a page of up to 64 MB, however little it holds: branches share what they have in common."""
    assert max(s.peakExecutionMemory() / s.numCompleteTasks() for s in _run(spark, name)) < limit * MB


def test_frames_are_joined_by_name(spark):
    """The join of masks with the rows of their frames sorts names of strips; their pixels come after it."""
    from maskwright.catalog.images import contents, strips
    from maskwright.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert set(strips(t).columns) == {"image_id", "y", "strip"}
    row = strips(t).where("y = 77").join(contents(t), "strip").selectExpr("image_id", "y", "values").first()
    assert list(row["values"]) == [(x * 7 + row["y"] * 13 + row["image_id"]) % 150 for x in range(256)]


def test_replacing_instances_moves_no_runs(spark):
    """Boxes are shuffled by image; the difference of masks that lie there moves nothing more."""
    wide = [s for s in _run(spark, "r16_replace_instance") if s.shuffleWriteRecords() > 0]
    assert sum(s.shuffleWriteRecords() for s in wide) < 2 * 6_100
