"""Geometry of masks from run moments; grouped jobs only where one mask's own rows are needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from maskwright.operators.runs import MASK, boundary_inner, mask_canvases

HULL_MIN_AREA = 10
ELLIPSE_MIN_AREA = 5
SKELETON_MIN_AREA = 20


def moments(runs: DataFrame, keys: list[str] = MASK) -> DataFrame:
    """Exact integer moments of each mask in one aggregation.

    For a run of n pixels starting at a: sum x = n(a+b-1)/2, and sum x^2 follows from the
    sum of squares below b minus that below a. Twice and six times the sums stay integers.
    """
    n = "cast(x1 - x0 as bigint)"
    sx2 = f"{n} * (x0 + x1 - 1)"
    below = "(cast({v} as bigint) - 1) * {v} * (2L * {v} - 1)"
    sxx6 = f"({below.format(v='x1')} - {below.format(v='x0')})"
    return runs.groupBy(*keys).agg(
        F.sum(F.expr(n)).alias("area"),
        F.sum(F.expr(sx2)).alias("sum_2x"),
        F.sum(F.expr(f"{n} * y")).alias("sum_y"),
        F.sum(F.expr(sxx6)).alias("sum_6xx"),
        F.sum(F.expr(f"{n} * y * y")).alias("sum_yy"),
        F.sum(F.expr(f"{sx2} * y")).alias("sum_2xy"),
        F.min("x0").alias("x_min"), F.max("x1").alias("x_end"),
        F.min("y").alias("y_min"), (F.max("y") + 1).alias("y_end"),
    )


def centroids(m: DataFrame) -> DataFrame:
    return m.withColumn("cx", F.col("sum_2x") / (2 * F.col("area"))).withColumn(
        "cy", F.col("sum_y") / F.col("area")
    )


def dist_to_center(cx: Column, cy: Column, height: int, width: int) -> Column:
    dx, dy = cx - F.lit(width / 2.0), cy - F.lit(height / 2.0)
    return F.sqrt(dx * dx + dy * dy)


def _eigen(m: DataFrame) -> DataFrame:
    """Eigenvalues of the pixel covariance (divisor n - 1) from centred integer sums."""
    n = F.col("area").cast("double")
    # Centred sums times n, in exact integer arithmetic (decimal(38,0) cannot overflow here).
    big = "decimal(38,0)"
    a = F.col("area").cast("decimal(18,0)")

    def d(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    cxx = ((2 * a * d("sum_6xx") - 3 * d("sum_2x") * d("sum_2x")).cast(big)).cast("double") / 12.0
    cyy = ((a * d("sum_yy") - d("sum_y") * d("sum_y")).cast(big)).cast("double")
    cxy = ((a * d("sum_2xy") - d("sum_2x") * d("sum_y")).cast(big)).cast("double") / 2.0
    scale = n * (n - 1)
    m = m.withColumn("_xx", cxx / scale).withColumn("_yy", cyy / scale).withColumn("_xy", cxy / scale)
    half = (F.col("_xx") + F.col("_yy")) / 2
    diff = (F.col("_xx") - F.col("_yy")) / 2
    root = F.sqrt(diff * diff + F.col("_xy") * F.col("_xy"))
    return m.withColumn("eig_max", half + root).withColumn("eig_min", half - root).drop("_xx", "_yy", "_xy")


def aspect_moment(m: DataFrame) -> DataFrame:
    """Axis ratio from second moments; fewer than three pixels give 1."""
    e = _eigen(m)
    floor = F.lit(1e-12)
    ratio = F.sqrt(F.greatest("eig_max", floor) / F.greatest("eig_min", floor))
    return e.withColumn("aspect_sym_moment", F.when(F.col("area") < 3, F.lit(1.0)).otherwise(ratio))


def perimeter(runs: DataFrame, keys: list[str] = MASK) -> DataFrame:
    """Pixel edges between a mask and its outside, plus extent and circularity."""
    at = [*keys, "y"]
    ends = runs.groupBy(*keys).agg(
        F.sum(F.expr("2L + 2L * (x1 - x0)")).alias("_edges"),
        F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area"),
        (F.max("x1") - F.min("x0")).cast("long").alias("bbox_w"),
        (F.max("y") - F.min("y") + 1).cast("long").alias("bbox_h"),
    )
    below = runs.selectExpr(*keys, "y - 1 as y", "x0 as _b0", "x1 as _b1")
    shared = runs.join(below, at).where("x0 < _b1 AND _b0 < x1").groupBy(*keys).agg(
        F.sum(F.expr("2L * (least(x1, _b1) - greatest(x0, _b0))")).alias("_shared")
    )
    out = ends.join(shared, keys, "left")
    p = (F.col("_edges") - F.coalesce("_shared", F.lit(0))).cast("double")
    return out.select(
        *keys, "area", "bbox_w", "bbox_h", p.alias("perimeter"),
        (F.col("area") / (F.col("bbox_w") * F.col("bbox_h"))).alias("extent"),
        (4 * F.lit(float(np.pi)) * F.col("area") / (p * p)).alias("circularity"),
    )


def edge_touch_ratio(runs: DataFrame, height: int, width: int, keys: list[str] = MASK) -> DataFrame:
    """Share of mask pixels on the frame border."""
    border = F.expr(
        f"case when y = 0 or y = {height - 1} then x1 - x0 "
        f"else (case when x0 = 0 then 1 else 0 end) + (case when x1 = {width} then 1 else 0 end) "
        f"- (case when x0 = 0 and x1 = {width} and {width} = 1 then 1 else 0 end) end"
    ).cast("long")
    return runs.groupBy(*keys).agg(
        F.sum(border).alias("border_px"), F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area")
    ).withColumn("edge_ratio", F.col("border_px") / F.col("area"))


def bbox_fill(runs: DataFrame, note: Column | None = None, minimum: float = 0.10) -> DataFrame:
    """Area over box area; a sparse mask gets a warning joined to its note."""
    m = moments(runs).select(*MASK, "area", (
        F.col("area") / ((F.col("x_end") - F.col("x_min")) * (F.col("y_end") - F.col("y_min")))
    ).alias("bbox_fill"))
    warn = F.when(F.col("bbox_fill") < F.lit(minimum), F.format_string("warning:bbox_fill_lt_0.10 (%.4f)", F.col("bbox_fill")))
    return m.withColumn("manual_note", F.concat_ws(" | ", note if note is not None else F.lit(None).cast("string"), warn))


# -- many masks at a time ------------------------------------------------------------


def _merged(pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint runs that do not touch, of any runs (start, end) on one axis."""
    order = np.argsort(pos, kind="stable")
    pos, reach = pos[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, pos[1:] > reach[:-1])) if len(pos) else np.zeros(0, np.int64)
    return pos[new], reach[np.append(new[1:], len(pos)) - 1] if len(new) else reach


def _labels(pos: np.ndarray, end: np.ndarray, wide: int, touch: int) -> np.ndarray:
    """Component of each run, named by its first run. Row r begins at r * ``wide`` and keeps two columns empty at either side."""
    # Runs of the row above that meet a run are neighbours in the sorted list.
    low = np.searchsorted(end, pos - wide - touch, side="right")
    count = np.maximum(np.searchsorted(pos, end - wide + touch, side="left") - low, 0)
    below = np.repeat(np.arange(len(pos)), count)
    above = np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    label = np.arange(len(pos))
    while len(above):
        a, b = label[above], label[below]
        apart = a != b
        above, below, a, b = above[apart], below[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label


def _clean(owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, masks: int, eight: bool) -> tuple[np.ndarray, ...]:
    """Largest component with holes filled, of many masks at once: (owner, y, x0, x1) of the runs, by mask and place.

    The masks stand one below the other on one axis of positions, row after row, with an empty row between them.
    """
    if not len(owner):
        return owner, y, x0, x1
    top, last, left = np.full(masks, 2 ** 31), np.full(masks, -2 ** 31), np.full(masks, 2 ** 31)
    np.minimum.at(top, owner, y)
    np.maximum.at(last, owner, y)
    np.minimum.at(left, owner, x0)
    top, last = np.where(top > last, 0, top), np.where(top > last, 0, last)  # masks without runs
    begin = np.append(0, np.cumsum(last - top + 3))  # rows of each mask, one empty row above and one below
    wide = int((x1 - left[owner]).max()) + 6
    row = begin[owner] + y - top[owner] + 1
    shift = row * wide - left[owner] + 3
    pos, end = _merged(x0 + shift, x1 + shift)
    label = _labels(pos, end, wide, int(eight))
    size = np.bincount(label, end - pos, len(pos))
    mask = np.searchsorted(begin, pos // wide, side="right") - 1
    first = np.flatnonzero(size)
    order = first[np.lexsort((first, -size[first], mask[first]))]
    best = order[np.append(True, np.diff(mask[order]) > 0)]
    keep = np.isin(label, best)
    pos, end = pos[keep], end[keep]
    # Holes: what lies between the runs of a row, unless it is joined (by edges) to the empty row above its mask.
    at = np.arange(begin[-1]) * wide
    free, stop = np.sort(np.concatenate([at + 2, end])), np.sort(np.concatenate([pos, at + wide - 2]))
    inner = _labels(free, stop, wide, 0)
    outside = np.searchsorted(free, begin[:-1] * wide + 2)
    hole = ~np.isin(inner, outside)
    pos, end = _merged(np.concatenate([pos, free[hole]]), np.concatenate([end, stop[hole]]))
    row = pos // wide
    mask = np.searchsorted(begin, row, side="right") - 1
    shift = row * wide - left[mask] + 3
    return mask, row - begin[mask] - 1 + top[mask], pos - shift, end - shift


CLEAN_RUNS = 1 << 20  # of one step, unless one mask has more


def _clean_lists(eight: bool):
    """Function from lists of runs to lists of runs, for whole Arrow batches; no list gives an empty one."""
    fields = [pa.field(n, pa.int32()) for n in ("y", "x0", "x1")]

    @F.arrow_udf("array<struct<y: int, x0: int, x1: int>>")
    def clean(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        y, x0, x1 = (part.to_numpy(zero_copy_only=False).astype(np.int64) for part in lists.flatten().flatten())
        ends, parts, at = np.cumsum(sizes), [], 0
        while at < len(sizes):
            seen = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, seen + CLEAN_RUNS, side="right")))
            part = slice(seen, ends[to - 1])
            some = x0[part] < x1[part]
            got = _clean(np.repeat(np.arange(to - at), sizes[at:to])[some], y[part][some], x0[part][some], x1[part][some], to - at, eight)
            parts.append((np.bincount(got[0], minlength=to - at), *got[1:]))
            at = to
        n, *runs = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        struct = pa.StructArray.from_arrays([pa.array(r.astype(np.int32)) for r in runs], fields=fields)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), struct)

    return clean


def clean_runs(runs: DataFrame, eight_connected: bool = True, keys: list[str] = MASK) -> DataFrame:
    """Largest connected component with holes filled, per mask.

    A mask with one run per row, each touching the one above, is clean already and stays in
    the JVM; the runs of the others are cleaned by array operations, whole Arrow batches of masks at once.
    """
    touch = 1 if eight_connected else 0
    w = W.partitionBy(*keys).orderBy("y", "x0")
    step = (
        (F.col("y") == F.lag("y").over(w) + 1)
        & (F.lag("x0").over(w) < F.col("x1") + touch)
        & (F.col("x0") < F.lag("x1").over(w) + touch)
    )
    flagged = runs.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")]).withColumn("_ok", F.coalesce(step, F.row_number().over(w) == 1))
    flagged = flagged.withColumn("_simple", F.min("_ok").over(W.partitionBy(*keys)))
    simple = flagged.where("_simple").select(*keys, "y", "x0", "x1")
    rest = flagged.where("NOT _simple").groupBy(*keys).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("r"))
    cleaned = rest.select(*keys, F.explode(_clean_lists(eight_connected)("r")).alias("c"))
    return simple.union(cleaned.select(*keys, "c.y", "c.x0", "c.x1"))


def _hull_area(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> float:
    """Area of the hull of the corners of the row extremes; rows ascend.

    The left and right chains are convex functions of y, so each is a one-sided scan.
    """
    def chain(ys: list, xs: list) -> float:
        """Twice the signed area under the upper convex chain of (y, x)."""
        hy, hx = [], []
        for y, x in zip(ys, xs):
            while len(hy) > 1 and (hx[-1] - hx[-2]) * (y - hy[-2]) <= (x - hx[-2]) * (hy[-1] - hy[-2]):
                hy.pop()
                hx.pop()
            hy.append(y)
            hx.append(x)
        return sum((hx[i] + hx[i + 1]) * (hy[i + 1] - hy[i]) for i in range(len(hy) - 1))

    # Each row spans y..y+1: a corner line carries the wider of the two rows that share it.
    ends: dict[int, list[int]] = {}
    for y, a, b in zip(rows.tolist(), lo.tolist(), hi.tolist()):
        for e in (y, y + 1):
            cur = ends.get(e)
            ends[e] = [a, b] if cur is None else [min(cur[0], a), max(cur[1], b)]
    ys = sorted(ends)
    return (chain(ys, [ends[y][1] for y in ys]) + chain(ys, [-ends[y][0] for y in ys])) / 2.0


def convex_area(runs: DataFrame, keys: list[str] = MASK) -> DataFrame:
    """Hull area of pixel corners; fewer than three pixels count themselves.

    Only the extremes of each row travel: their number is the mask height, not its size.
    """
    rows = runs.groupBy(*keys, "y").agg(
        F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("n")
    )
    per = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("y", "lo", "hi"))).alias("r"), F.sum("n").alias("area")
    ).select(*keys, "area", "r.y", "r.lo", "r.hi")

    @F.pandas_udf("double")
    def hull(y: pd.Series, lo: pd.Series, hi: pd.Series, area: pd.Series) -> pd.Series:
        return pd.Series(
            [float(n) if n < 3 else _hull_area(a, b, c) for a, b, c, n in zip(y, lo, hi, area)], dtype="float64"
        )

    return per.select(*keys, "area", hull("y", "lo", "hi", "area").alias("convex_area"))


def solidity(runs: DataFrame, keys: list[str] = MASK, min_area: int = HULL_MIN_AREA) -> DataFrame:
    """Area over hull area; NULL below ``min_area``."""
    value = F.when(F.col("convex_area") > 0, F.col("area") / F.col("convex_area")).otherwise(F.lit(1.0))
    return convex_area(runs, keys).select(*keys, F.when(F.col("area") >= min_area, value).alias("solidity"))


def mask_metrics(runs: DataFrame, height: int, width: int, all_masks: DataFrame | None = None) -> DataFrame:
    """Area before and after cleaning, box, centroid, distance, axis ratio and solidity."""
    raw = moments(runs).select(*MASK, F.col("area").alias("area_raw"))
    clean = clean_runs(runs)
    m = aspect_moment(centroids(moments(clean)))
    out = raw.join(m, MASK, "left").join(solidity(clean), MASK, "left")
    out = out.select(
        *MASK, "area_raw", F.col("area").alias("area_clean"),
        (F.col("x_end") - F.col("x_min")).cast("long").alias("bbox_w"),
        (F.col("y_end") - F.col("y_min")).cast("long").alias("bbox_h"),
        F.bround("cx", 2).alias("centroid_x"), F.bround("cy", 2).alias("centroid_y"),
        F.bround(dist_to_center(F.col("cx"), F.col("cy"), height, width), 2).alias("dist_to_center"),
        F.bround("aspect_sym_moment", 4).alias("aspect_sym_moment"),
        F.bround("solidity", 4).alias("solidity"),
    )
    if all_masks is None:
        return out
    return all_masks.select(*MASK).join(out, MASK, "left").na.fill(0, ["area_raw", "area_clean"])


def _thin(img: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of a padded binary image."""
    work = img.astype(np.uint8)
    while True:
        removed = 0
        for step in (0, 1):
            p = [np.roll(work, s, axis=(0, 1)) for s in
                 ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            total = sum(p)
            turns = sum((p[i] < p[(i + 1) % 8]).view(np.uint8) for i in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            side = ((n & e & s) | (e & s & w)) if step == 0 else ((n & e & w) | (n & s & w))
            kill = (work == 1) & (total >= 2) & (total <= 6) & (turns == 1) & (side == 0)
            work[kill] = 0
            removed += int(kill.sum())
        if not removed:
            return work.astype(bool)


@F.pandas_udf(LongType())
def _skeleton_px(y: pd.Series, x0: pd.Series, x1: pd.Series) -> pd.Series:
    """Skeleton pixels of each mask; the masks of a batch are thinned together."""
    out = np.zeros(len(y), dtype=np.int64)
    for first, last, img, top, _, _ in mask_canvases(y, x0, x1, 1):
        out[first:last] = np.add.reduceat(_thin(img).sum(axis=1), top[:-1])
    return pd.Series(out)


def curvature_ratio(runs: DataFrame, keys: list[str] = MASK) -> DataFrame:
    """Skeleton pixels over twice the root of the larger eigenvalue; NULL for small masks."""
    m = _eigen(moments(runs, keys)).where(F.col("area") >= SKELETON_MIN_AREA)
    rows = runs.groupBy(*keys).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("r"))
    axis = 2 * F.sqrt(F.greatest("eig_max", F.lit(1e-12)))
    joined = m.select(*keys, axis.alias("_axis")).join(rows, keys).select(
        *keys, "_axis", _skeleton_px("r.y", "r.x0", "r.x1").alias("skeleton_px"))
    return runs.select(*keys).distinct().join(joined, keys, "left").select(
        *keys,
        F.when((F.col("skeleton_px") >= 1) & (F.col("_axis") >= 1), F.col("skeleton_px") / F.col("_axis"))
        .alias("curvature_ratio"),
    )


def aspect_boundary(runs: DataFrame, keys: list[str] = MASK) -> DataFrame:
    """Axis ratio of the conic fitted by least squares to the boundary pixels.

    Power sums to order four are aggregated in Spark; the 5x5 system is solved per mask.
    """
    area = moments(runs, keys).selectExpr(*keys, "area", "sum_2x / (2 * area) as _mx", "sum_y / area as _my",
                           "greatest(x_end - x_min, y_end - y_min) / double(2) as _s")
    px = boundary_inner(runs, keys).select(*keys, "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))
    px = px.join(area.where(F.col("area") >= ELLIPSE_MIN_AREA), keys)
    px = px.withColumn("u", (F.col("x") - F.col("_mx")) / F.col("_s")).withColumn(
        "v", (F.col("y") - F.col("_my")) / F.col("_s"))
    powers = [(i, j) for i in range(5) for j in range(5 - i)]
    sums = px.groupBy(*keys).agg(
        *[F.sum(F.pow("u", F.lit(i)) * F.pow("v", F.lit(j))).alias(f"s{i}{j}") for i, j in powers]
    )

    @F.pandas_udf("double")
    def solve(s: pd.DataFrame) -> pd.Series:
        terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1)]
        out = []
        for row in s.itertuples(index=False):
            g = {(i, j): getattr(row, f"s{i}{j}") for i, j in powers}
            if g[(0, 0)] < 5:
                out.append(None)
                continue
            mat = np.array([[g[(a[0] + b[0], a[1] + b[1])] for b in terms] for a in terms])
            vec = np.array([g[t] for t in terms])
            try:
                a, b, c, _, _ = np.linalg.solve(mat, vec)
            except np.linalg.LinAlgError:
                out.append(None)
                continue
            lo, hi = np.linalg.eigvalsh([[a, b / 2], [b / 2, c]])
            out.append(float(np.sqrt(hi / lo)) if lo > 1e-12 else None)
        return pd.Series(out, dtype="float64").replace({np.nan: None})

    fitted = sums.select(*keys, solve(F.struct(*[f"s{i}{j}" for i, j in powers])).alias("aspect_sym_boundary"))
    return area.select(*keys).join(fitted, keys, "left")


def instance_stats(runs: DataFrame, instances: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """The eleven shape figures of each typed instance, on its 4-connected cleaned mask.

    ``instances``: image_id, inst_id, type_label. ``thresholds``: image_id, sb_threshold;
    images without one get 32.0. Instances without a type are left out.
    """
    clean = clean_runs(runs, eight_connected=False)
    per = perimeter(clean)
    m = aspect_moment(moments(clean)).select(*MASK, "aspect_sym_moment")
    hull = convex_area(clean).select(*MASK, "convex_area")
    out = (
        instances.select(*MASK, F.col("type_label").alias("feature_type")).where("feature_type is not null")
        .join(per, MASK).join(m, MASK).join(hull, MASK)
        .join(aspect_boundary(clean), MASK, "left").join(curvature_ratio(clean), MASK, "left")
    )
    if thresholds is None:
        out = out.withColumn("sb_threshold", F.lit(32.0))
    else:
        out = out.join(thresholds.select("image_id", "sb_threshold"), "image_id", "left").withColumn(
            "sb_threshold", F.coalesce("sb_threshold", F.lit(32.0)))
    return out.select(
        *MASK, "sb_threshold", "feature_type", "area", "bbox_w", "bbox_h",
        *[F.bround(c, 4).alias(c) for c in ("aspect_sym_moment", "aspect_sym_boundary", "curvature_ratio", "extent")],
        F.bround("perimeter", 2).alias("perimeter"),
        F.bround(F.col("area") / F.col("convex_area"), 4).alias("solidity"),
        F.bround("circularity", 4).alias("circularity"),
    )
