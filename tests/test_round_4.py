"""Steps that moved more than the boxes (findings of round 4), and what they give."""

import pytest
from test_round_3_size import _run


def _moved(spark, name):
    """Rows that a query shuffles, joins not broadcast; the boxes of sf0.001 are 6,000."""
    return sum(s.shuffleWriteRecords() for s in _run(spark, name))


@pytest.mark.parametrize("name", ["a31_residual", "x11_expected_snr", "x13_scale_for_snr", "x15_render_batch", "x3_asinh_stretch", "x5_multi_exposure",
                                  "x5_multi_exposure_zscale", "a31_image_stats", "x1_mag_to_flux", "a31_histogram"])
def test_pixels_stay_with_their_image(spark, name):
    assert _moved(spark, name) < 2 * 6_100


def test_regions_count_equal_values_once(spark):
    """Means of the brightest and faintest share: repeated values, one value only, no value, rows without one."""
    from maskwright.operators import imaging as I

    rows = [(1, float(v)) for v in (1, 1, 1, 2, 2, 3, 9, 9)] + [(1, None)] + [(2, 5.0)] * 3 + [(3, None)]
    df = spark.createDataFrame(rows, "image_id long, v double")
    got = {r.image_id: (r.s, r.b) for r in I.region_means(df, "v", 0.75, 0.25).collect()}
    assert got == {1: (9.0, 1.0), 2: (5.0, 5.0), 3: (None, None)}  # bounds of image 1: 4.5 and 1
    flagged = I.regions(df, "v", 0.75, 0.25).where("image_id = 1 AND v is not null").collect()
    assert sorted((r.v, r.in_signal, r.in_background) for r in flagged)[-1] == (9.0, True, False) and sum(r.in_signal for r in flagged) == 2


def test_pixels_of_crowded_images(spark):
    """The same pixels whether images lie together or not."""
    from maskwright.catalog.images import pixels
    from maskwright.plans import fixtures

    found = []
    for crowded in (fixtures.CROWDED, 1):
        given, fixtures.CROWDED = fixtures.CROWDED, crowded
        try:
            found.append(sorted(tuple(r) for r in pixels(fixtures.Tables(spark, "/root/testdata/sf0.001")).select("image_id", "y", "x", "stamp").where("image_id < 9").collect()))
        finally:
            fixtures.CROWDED = given
    assert found[0] == found[1] and len(found[0]) > 1000


@pytest.mark.parametrize("name", ["g7_aspect_boundary", "s4_prediction_documents", "m10_paint_stream_first"])
def test_masks_and_their_numbers_stay_with_their_image(spark, name):
    assert _moved(spark, name) < 2 * 6_100


def test_numbers_in_place_are_the_numbers_by_ranges(spark):
    """A group without a name, groups of one, an order that falls, and the setting as crowded images have it."""
    from maskwright.operators.numbering import number_rows
    from pyspark.sql import functions as F

    key = "spark.sql.requireAllClusterKeysForCoPartition"
    given, found = spark.conf.get(key), []
    df = spark.createDataFrame([(i % 3 if i % 5 else None, "ab"[i % 2], i) for i in range(40)], "image_id long, kind string, o long")
    for way in ("true", "false"):
        spark.conf.set(key, way)
        try:
            found.append(sorted(map(str, number_rows(df, ["image_id", "kind"], [F.desc("o")], "n", start=0).select("image_id", "kind", "o", "n").collect())))
        finally:
            spark.conf.set(key, given)
    assert found[0] == found[1] and len(found[0]) == 40


def test_rows_of_a_fold_come_together_and_in_order(spark):
    from maskwright.operators.replay import in_order

    df = spark.createDataFrame([(i % 7, i * 37 % 11, i) for i in range(100)], "image_id long, a long, b long").repartition(5)
    parts = in_order(df, "a", "b").rdd.glom().collect()
    seen = [r.image_id for p in parts for r in {r.image_id: r for r in p}.values()]
    assert sorted(seen) == list(range(7))  # each image in one task
    assert all([(r.image_id, r.a, r.b) for r in p] == sorted((r.image_id, r.a, r.b) for r in p) for p in parts)
