"""Named queries: renderings, noise and image evidence. Pixels are those of the masks."""

from pyspark.sql import functions as F

from maskwright.catalog import query
from maskwright.functions import photometry as P
from maskwright.operators import imaging as I
from maskwright.operators.runs import BAND, tile_runs
from maskwright.plans.fixtures import SIDE
from maskwright.session import lies_by_image

# Every pixel of the ground truth masks; its value follows from its place and the first mask on it.
_K = "(x * 7 + y * 13 + stamp)"
PX = {"px": f"""
    SELECT image_id, y, x, stamp, CASE WHEN {_K} % 97 = 0 THEN NULL ELSE 20 + ({_K} % 150) / 10.0::DOUBLE END AS raw,
           CASE WHEN {_K} % 97 = 0 THEN 35.0::DOUBLE ELSE 20 + ({_K} % 150) / 10.0::DOUBLE END AS mag
    FROM (SELECT image_id, y, x, min(inst_id) AS stamp FROM gt_px GROUP BY ALL)""",
      "fx": "SELECT *, pow(10, (22.5 - mag) / 2.5) AS flux FROM px",
      "vm": "SELECT image_id, quantile_cont(flux, 0.995) AS vmax FROM fx GROUP BY ALL",
      "st": "SELECT fx.*, vmax, asinh(flux / (vmax + 1e-10) * 300) / asinh(300::DOUBLE) AS g FROM fx JOIN vm USING (image_id)"}


PIXEL_BOXES = 12_500  # of one task; some 130 pixels to a mask


def pixels(t):
    """Pixels of the ground truth, made and kept where the boxes of their images lie, so that no pixel is shuffled for a
    pixel's first mask nor for what is later asked of its image."""
    t.rows_per_task = PIXEL_BOXES
    runs = t.gt_runs.select("image_id", "inst_id", "y", "x0", "x1")
    if lies_by_image(t.spark):
        px = runs.select("image_id", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"), "inst_id").groupBy("image_id", "y", "x")
    else:
        # Crowded images: runs go to the task of their block and become pixels there. The number of tasks
        # is named, as adaptive coalescing would size them for the runs.
        runs = tile_runs(runs).withColumn("band", F.expr(f"cast(floor(y / {BAND}) as int)"))
        runs = runs.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "image_id", "band", "tile")
        px = runs.select("image_id", "band", "tile", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"), "inst_id").groupBy("image_id", "band", "tile", "y", "x")
    px = px.agg(F.min("inst_id").alias("stamp")).drop("band", "tile")
    return px.withColumn("mag", F.expr(f"case when {_K} % 97 = 0 then double('NaN') else 20 + ({_K} % 150) / double(10) end"))


def frames(t, n):
    """Whole square frames of ``n`` pixels a side, for the resize."""
    grid = t.images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("x"))
    return grid.withColumn("mag", F.expr("20 + ((x * 7 + y * 13 + image_id) % 150) / double(10)"))


def per_row(df, value, scale=1):
    """Pixels and sum of a figure, in whole parts of 1 / ``scale``, of each row of an image."""
    return df.groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(value) * scale).cast("long")).alias("total"))


def _rows(value, table, scale=1):
    return f"SELECT image_id, y, count(*) AS n, sum(round({value} * {scale})::BIGINT)::BIGINT AS total FROM {table} GROUP BY ALL"


def cleaned(t):
    return pixels(t).withColumn("mag", P.clean_pixel(F.col("mag")))


@query("x1_mag_to_flux", "SELECT image_id, sum(flux) AS total, max(flux) AS top FROM (SELECT image_id, round(flux, 6) AS flux FROM fx) GROUP BY ALL", doubles="total top", ctes=PX)
def _(t):
    f = cleaned(t).select("image_id", F.round(P.mag_to_flux(F.col("mag")), 6).alias("flux"))
    return f.groupBy("image_id").agg(F.sum("flux").alias("total"), F.max("flux").alias("top"))


@query("x2_clean_pixels", "SELECT image_id, count(*) FILTER (raw IS NULL) AS n_bad, max(mag) AS faintest FROM px GROUP BY ALL", ctes=PX)
def _(t):
    p = pixels(t).withColumn("c", P.clean_pixel(F.col("mag")))
    return p.groupBy("image_id").agg(F.count_if(F.isnan("mag")).alias("n_bad"), F.max("c").alias("faintest"))


@query("x3_asinh_stretch", _rows("g", "st", 1000), ctes=PX)
def _(t):
    return per_row(I.asinh_render(pixels(t)), "value", 1000)


@query("x4_linear_magnitude", _rows("trunc((35 - mag) / 15 * 255)", "px"), ctes=PX)
def _(t):
    return per_row(I.linear_render(pixels(t)), "level")


@query("x5_multi_exposure", """
    SELECT image_id, min(trunc((35 - mag) / 15 * 255))::INTEGER AS r_min, max(trunc((35 - mag) / 15 * 255))::INTEGER AS r_max, avg(trunc((35 - mag) / 15 * 255)) AS r_mean,
           count(raw)::DOUBLE / count(*) AS raw_finite_pixel_ratio, round(max(vmax), 6) AS vmax_ref_flux FROM (SELECT st.*, px.raw AS r0 FROM st JOIN px USING (image_id, y, x)) GROUP BY ALL""",
    doubles="r_mean raw_finite_pixel_ratio", ctes=PX)
def _(t):
    s = I.exposure_stats(I.multi_exposure(pixels(t)))
    return s.select("image_id", "r_min", "r_max", "r_mean", "raw_finite_pixel_ratio", F.round("vmax_ref_flux", 6).alias("vmax_ref_flux"))


@query("x5_multi_exposure_zscale")
def _(t):
    return I.exposure_stats(I.multi_exposure(pixels(t), "zscale_asinh", b_gain=1.1))


@query("x6_resize_bicubic")
def _(t):
    return I.resize_bicubic(I.asinh_render(frames(t, 16)), 16, 7).withColumn("value", F.round("value", 9))


@query("x7_counts_to_sb", _rows("CASE WHEN c > 0 THEN -2.5 * log10(c) + 30 - 2.5 * log10(0.187 * 0.187) ELSE 35 END", f"(SELECT *, ({_K} % 150 - 5)::DOUBLE AS c FROM px)", 1000), ctes=PX)
def _(t):
    c = pixels(t).withColumn("c", F.expr(f"cast({_K} % 150 - 5 as double)"))
    return per_row(c.withColumn("sb", P.counts_to_sb(F.col("c"), 30.0, 0.187)), "sb", 1000)


_SNR = {**PX, "q": "SELECT image_id, quantile_cont(flux, 0.9) AS hi, quantile_cont(flux, 0.2) AS lo FROM fx GROUP BY ALL",
        "mm": "SELECT image_id, avg(flux) FILTER (flux >= hi) AS s, avg(flux) FILTER (flux <= lo) AS b FROM fx JOIN q USING (image_id) GROUP BY ALL"}


@query("x11_expected_snr", """
    SELECT image_id, round(s * 10000, 4) AS expected_sig, round(sqrt(b * 10000 + 225), 6) AS expected_noise, round(s * 10000 / sqrt(b * 10000 + 225), 4) AS snr FROM mm""", ctes=_SNR)
def _(t):
    return I.expected_snr(cleaned(t)).select("image_id", F.round("expected_sig", 4).alias("expected_sig"), F.round("expected_noise", 6).alias("expected_noise"), F.round("snr", 4).alias("snr"))


@query("x13_scale_for_snr")
def _(t):
    return I.scale_for_snr(cleaned(t), 50.0)


@query("x15_render_batch", """
    SELECT 'linear_magnitude' AS variant, count(*) AS n, sum(trunc((35 - mag) / 15 * 255))::BIGINT AS r FROM px UNION ALL
    SELECT 'multi_exposure', count(*), sum(trunc((35 - mag) / 15 * 255))::BIGINT FROM px""", ctes=PX)
def _(t):
    return I.render_batch(pixels(t), ["linear_magnitude", "multi_exposure"]).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"))


@query("a31_image_stats", """
    SELECT image_id, count(raw) AS n_finite, min(raw) AS v_min, avg(raw) AS v_mean, max(raw) AS v_max, stddev_pop(raw) AS v_std, quantile_cont(raw, 0.01) AS p01,
           quantile_cont(raw, 0.5) AS median, quantile_cont(raw, 0.99) AS p99 FROM px GROUP BY ALL""", doubles="v_min v_mean v_max v_std p01 median p99", ctes=PX)
def _(t):
    return I.image_stats(pixels(t))


@query("a31_histogram", """
    SELECT image_id, bin, n, sum(n) OVER (PARTITION BY image_id ORDER BY bin)::DOUBLE / sum(n) OVER (PARTITION BY image_id) AS cdf FROM (
      SELECT image_id, least(15, floor((mag - 20) / 1.0::DOUBLE) + 1)::BIGINT AS bin, count(*) AS n FROM px GROUP BY ALL)""", doubles="cdf", ctes=PX)
def _(t):
    return I.histogram(cleaned(t), 20.0, 35.0, 15)


@query("a31_residual", """
    SELECT a.image_id, count(*) AS n, round(sum(abs(a.mag - b.mag)), 6) AS total FROM px a JOIN px b ON b.image_id = a.image_id AND a.y = b.x AND a.x = b.y GROUP BY ALL""", ctes=PX)
def _(t):
    a = cleaned(t)
    r = I.residual(a, a.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "mag"))
    return r.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("residual")), 6).alias("total"))


@query("a31_header_diff", """
    SELECT coalesce(a.k, b.k) AS key, a.v AS a, b.v AS b FROM (SELECT n_name AS k, n_regionkey::VARCHAR AS v FROM nation WHERE n_nationkey % 4 <> 0) a
    FULL JOIN (SELECT n_name AS k, (n_regionkey % 3)::VARCHAR AS v FROM nation WHERE n_nationkey % 5 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def _(t):
    n = t.nation
    return I.header_diff(n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")),
                         n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("key"), (F.col("n_regionkey") % 3).cast("string").alias("value")))


# -- evidence: the signal of a frame around each mask ---------------------------------------------

def strips(t):
    """Rows of the frames by the name of their values. There are 150 different ones, made once (``contents``)."""
    row = t.images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y"))
    return row.withColumn("strip", F.expr("(y * 13 + image_id) % 150"))


def contents(t):
    return F.broadcast(t.spark.range(150).select(
        F.col("id").alias("strip"), F.expr(f"transform(sequence(0, {SIDE - 1}), x -> cast((x * 7 + id) % 150 as smallint))").alias("values")))


_RING = {"rings": """
    SELECT image_id, inst_id, r, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d, ((x * 7 + y * 13 + image_id) % 150)::DOUBLE AS s FROM (
      SELECT *, unnest(range(greatest(0, floor(cx - 6 * r))::BIGINT, least(255, ceil(cx + 6 * r))::BIGINT + 1)) AS x FROM (
        SELECT image_id, inst_id, cx, cy, sqrt(area / pi()) AS r, unnest(range(greatest(0, floor(cy - 6 * sqrt(area / pi())))::BIGINT, least(255, ceil(cy + 6 * sqrt(area / pi())))::BIGINT + 1)) AS y
        FROM pred_m WHERE type_label = 'satellites'))""",
    "ann": """
    SELECT image_id, inst_id, round(avg(s) FILTER (d >= 1.2::DOUBLE * r AND d < 2 * r) - avg(s) FILTER (d >= 4 * r AND d < 6 * r), 6) AS annulus_excess FROM rings GROUP BY ALL""",
    "rad": """
    SELECT image_id, inst_id, CASE WHEN count(*) = 6 THEN (count(*) FILTER (m < p))::DOUBLE / 5 END AS radial_monotonicity FROM (
      SELECT *, lag(m) OVER (PARTITION BY image_id, inst_id ORDER BY k) AS p FROM (
        SELECT image_id, inst_id, floor(d / (r * 2.0::DOUBLE / 6)) AS k, round(avg(s), 9) AS m FROM rings WHERE floor(d / (r * 2.0::DOUBLE / 6)) < 6 GROUP BY ALL)) GROUP BY ALL"""}


@query("g10_annulus_excess", "SELECT * FROM ann", ctes=_RING)
def _(t):
    e = I.annulus_excess(t.sats.select("image_id", "inst_id", "area", "cx", "cy"), strips(t), SIDE, SIDE, contents=contents(t))
    return e.select("image_id", "inst_id", F.round("annulus_excess", 6).alias("annulus_excess"))


@query("g11_radial_monotonicity", "SELECT * FROM rad", doubles="radial_monotonicity", ctes=_RING)
def _(t):
    return I.radial_monotonicity(t.sats.select("image_id", "inst_id", "area", "cx", "cy"), strips(t), SIDE, SIDE, contents=contents(t))


@query("a5_candidate_table", """
    SELECT image_id, inst_id, inst_id AS raw_index, area AS seed_area, score AS confidence_score, matched_gt_id, matched_gt_area, overlap_px, purity, completeness, seed_gt_ratio,
           is_one_to_one, NULL::DOUBLE AS host_background_frac, intersects_roi, annulus_excess, radial_monotonicity, taxonomy_label, label_reason
    FROM candidates LEFT JOIN ann USING (image_id, inst_id) LEFT JOIN rad USING (image_id, inst_id)""",
    doubles="confidence_score purity completeness seed_gt_ratio radial_monotonicity", ctes=_RING)
def _(t):
    c = I.candidate_table(t.candidates, t.sats.select("image_id", "inst_id", "area", "cx", "cy"), strips(t), SIDE, SIDE, contents=contents(t))
    return c.withColumn("annulus_excess", F.round("annulus_excess", 6))
