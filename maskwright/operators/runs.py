"""Masks as half-open horizontal runs ``(y, x0, x1)``, one row per run.

Set algebra works on runs cut at fixed column tiles. A key ``(image, y, tile)`` then
holds at most ``TILE`` distinct start columns after pre-aggregation, whatever the
number of masks in the image, so no step depends on how crowded one image is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from maskwright.session import lies_by_image

TILE = 64
BAND = 32  # rows of a block
IMAGE = ["image_id"]
MASK = ["image_id", "inst_id"]


def box_runs(boxes: DataFrame, keep: Sequence[str] = MASK) -> DataFrame:
    """Rows of filled boxes with columns y0, y1, x0, x1 (half-open)."""
    rows = boxes.where("y0 < y1 AND x0 < x1")
    return rows.select(*keep, F.explode(F.expr("sequence(y0, y1 - 1)")).alias("y"), "x0", "x1")


def tile_runs(runs: DataFrame, tile: int = TILE) -> DataFrame:
    """Cut runs at tile borders; adds ``tile``. Lengths add up to the original runs."""
    cut_ = runs.where("x0 < x1").withColumn(
        "tile", F.explode(F.expr(f"sequence(x0 div {tile}, (x1 - 1) div {tile})"))
    )
    return cut_.withColumn("x0", F.expr(f"cast(greatest(x0, tile * {tile}) as int)")).withColumn(
        "x1", F.expr(f"cast(least(x1, (tile + 1) * {tile}) as int)")
    )


def areas(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("area"))


def split_instances(runs: DataFrame, min_area: int = 1) -> DataFrame:
    """Instances with at least ``min_area`` pixels."""
    return areas(runs).where(F.col("area") >= min_area)


def bboxes(runs: DataFrame, keys: Sequence[str] = MASK, all_masks: DataFrame | None = None) -> DataFrame:
    """Box as x, y, width, height; masks of ``all_masks`` without runs get zeros."""
    box = runs.groupBy(*keys).agg(
        F.min("x0").cast("double").alias("bbox_x"),
        F.min("y").cast("double").alias("bbox_y"),
        (F.max("x1") - F.min("x0")).cast("double").alias("bbox_w"),
        (F.max("y") - F.min("y") + 1).cast("double").alias("bbox_h"),
    )
    if all_masks is None:
        return box
    return all_masks.select(*keys).join(box, list(keys), "left").na.fill(0.0)


def union_runs(runs: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """OR of all masks under ``keys``: disjoint runs per (keys, y, tile)."""
    at = [*keys, "y", "tile"]
    widest = tile_runs(runs).groupBy(*at, "x0").agg(F.max("x1").alias("x1"))
    w = W.partitionBy(*at).orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = widest.withColumn("_new", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0))
    island = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        island.groupBy(*at, "_island")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_island")
    )


def merge_tiles(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join touching runs again after set algebra on tiles (disjoint input)."""
    at = [*keys, "y"]
    w = W.partitionBy(*at).orderBy("x0")
    flagged = runs.withColumn("_new", F.when(F.lag("x1").over(w) == F.col("x0"), 0).otherwise(1))
    island = flagged.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*at, "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_i")


def intersect_area(a: DataFrame, b: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Pixels common to two tiled unions, per ``keys``."""
    at = [*keys, "y", "tile"]
    right = b.select(*at, F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    hit = a.join(right, at).where("x0 < _b1 AND _b0 < x1")
    return hit.groupBy(*keys).agg(
        F.sum(F.expr("cast(least(x1, _b1) - greatest(x0, _b0) as bigint)")).alias("inter")
    )


def difference_runs(a: DataFrame, b_union: DataFrame, keys: Sequence[str] = MASK,
                    on: Sequence[str] = IMAGE, null_keys: bool = True) -> DataFrame:
    """Pixels of each mask in ``a`` not covered by the tiled union ``b_union``.

    With ``null_keys`` a missing key equals a missing key, which moves rows that already lie by their keys.

    At most TILE/2 disjoint runs of the union meet one tiled run, so the collected list is short.
    """
    at = [*on, "y", "tile"]
    left = tile_runs(a)
    right = b_union.select(*at, F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    cond = [left[c].eqNullSafe(right[c]) if null_keys else left[c] == right[c] for c in at]
    cond += [left["x0"] < right["_b1"], right["_b0"] < left["x1"]]
    joined = left.join(right, cond, "left").select(
        *[left[c] for c in dict.fromkeys([*keys, "y", "tile", "x0", "x1"])], "_b0", "_b1"
    )
    gaps = joined.groupBy(*keys, "y", "tile", "x0", "x1").agg(
        F.sort_array(F.collect_list(F.expr("case when _b0 is not null then struct(_b0, _b1) end"))).alias("_b")
    )
    pieces = gaps.withColumn("_start", F.expr("concat(array(x0), transform(_b, s -> s._b1))")).withColumn(
        "_end", F.expr("concat(transform(_b, s -> s._b0), array(x1))")
    )
    parts = pieces.select(
        *keys, "y", "tile",
        F.explode(F.arrays_zip("_start", "_end")).alias("_p"), "x0", "x1",
    )
    return parts.select(
        *keys, "y", "tile",
        F.expr("cast(greatest(_p._start, x0) as int)").alias("x0"),
        F.expr("cast(least(_p._end, x1) as int)").alias("x1"),
    ).where("x0 < x1")


def paint(runs: DataFrame, priority: Column, label: str = "inst_id", keys: Sequence[str] = IMAGE) -> DataFrame:
    """Label map of overlapping masks: on each pixel the mask with the greatest priority wins.

    ``priority`` must be unique per mask inside ``keys``. Before anything is collected,
    equal run extents in a tile are reduced to their best mask, so a list holds at most
    TILE * (TILE + 1) / 2 extents.
    """
    at = [*keys, "band", "y", "tile"]
    cut_ = tile_runs(runs.withColumn("_p", priority)).withColumn("band", F.expr(f"cast(floor(y / {BAND}) as int)"))
    cut_ = cut_.select(*at, "x0", "x1", "_p", *([label] if label not in at else []))
    # One exchange by blocks serves both aggregations, and rows of a mask that stay together compress well. Where masks lie by image there is none.
    if "image_id" not in keys or not lies_by_image(runs.sparkSession):
        cut_ = cut_.repartition(*keys, "band", "tile")
    best = (
        cut_.groupBy(*at, "x0", "x1")
        .agg(F.max(F.struct("_p", label)).alias("_w"))
    )
    cell = best.groupBy(*at).agg(F.collect_list(F.struct("x0", "x1", "_w")).alias("_runs"))
    cell = cell.withColumn(
        "_e",
        F.expr("array_sort(array_distinct(concat(transform(_runs, r -> r.x0), transform(_runs, r -> r.x1))))"),
    )
    parts = cell.select(*at, "_runs", "_e", F.explode(F.expr("sequence(1, size(_e) - 1)")).alias("_i"))
    won = parts.select(
        *at,
        F.expr("element_at(_e, _i)").alias("x0"),
        F.expr("element_at(_e, _i + 1)").alias("x1"),
        F.expr(
            "array_max(transform(filter(_runs, r -> r.x0 <= element_at(_e, _i) "
            "AND r.x1 >= element_at(_e, _i + 1)), r -> r._w))"
        ).alias("_w"),
    ).where("_w is not null")
    return won.select(*keys, "y", "tile", "x0", "x1", F.col(f"_w.{label}").alias(label))


def resample_runs(runs: DataFrame, src: int, dst: int, keys: Sequence[str] = MASK) -> DataFrame:
    """Nearest-neighbour resize of a square frame: target j reads source floor(j * src / dst)."""
    # First target index whose source is >= v is ceil(v * dst / src).
    up = "cast(({v} * {d} + {s} - 1) div {s} as int)"

    def edge(v: str) -> str:
        return up.format(v=v, d=f"{dst}L", s=src)

    rows = runs.select(
        *keys,
        F.explode(
            F.expr(f"case when {edge('y')} < {edge('(y + 1)')} "
                   f"then sequence({edge('y')}, {edge('(y + 1)')} - 1) else array() end")
        ).alias("y"),
        F.expr(edge("x0")).alias("x0"),
        F.expr(edge("x1")).alias("x1"),
    )
    return rows.where("x0 < x1")


def lost_ids(native: DataFrame, resampled: DataFrame) -> DataFrame:
    """Instances that have pixels in the native frame and none after resampling."""
    return native.select(*MASK).distinct().join(resampled.select(*MASK).distinct(), MASK, "left_anti")


def runs_of_pixels(pixels: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Pixel list clipped to the frame, turned into runs."""
    px = pixels.select(
        *keys,
        F.expr(f"cast(greatest(0, least(y, {height - 1})) as int)").alias("y"),
        F.expr(f"cast(greatest(0, least(x, {width - 1})) as int)").alias("x"),
    ).distinct()
    w = W.partitionBy(*keys, "y").orderBy("x")
    isl = px.withColumn("_i", F.col("x") - F.row_number().over(w))
    return isl.groupBy(*keys, "y", "_i").agg(
        F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")
    ).drop("_i")


def column_runs(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Vertical runs ``(x, y0, y1)`` of row runs."""
    px = runs.select(*keys, "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))
    w = W.partitionBy(*keys, "x").orderBy("y")
    isl = px.withColumn("_i", F.col("y") - F.row_number().over(w))
    return isl.groupBy(*keys, "x", "_i").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")
    ).drop("_i")


CANVAS = 4_000_000
_RUNS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("y", "x0", "x1")]))


def mask_canvases(y: pd.Series, x0: pd.Series, x1: pd.Series, pad: int):
    """Masks of an Arrow batch drawn one below the other with ``pad`` empty pixels around each.

    Yields (first, last, image, top rows, frame y of each row, frame x of column 0 of each row).
    """
    low = np.array([v.min() for v in y])
    tall = np.array([v.max() for v in y]) - low + 1 + 2 * pad
    left = np.array([v.min() for v in x0])
    wide = np.array([v.max() for v in x1]) - left + 2 * pad
    first = 0
    while first < len(y):
        last, width, height = first, 0, 0
        while last < len(y) and (last == first or (height + tall[last]) * max(width, wide[last]) <= CANVAS):
            height, width = height + tall[last], max(width, wide[last])
            last += 1
        top = np.concatenate([[0], np.cumsum(tall[first:last])])
        part = range(first, last)
        row = np.concatenate([y.iloc[i] - low[i] + pad + top[i - first] for i in part])
        a = np.concatenate([x0.iloc[i] - left[i] + pad for i in part])
        b = np.concatenate([x1.iloc[i] - left[i] + pad for i in part])
        marks = np.zeros((height, width + 1), dtype=np.int16)
        np.add.at(marks, (row, a), 1)
        np.add.at(marks, (row, b), -1)
        owner = np.repeat(np.arange(first, last), tall[first:last])
        frame_y = np.arange(height) - top[owner - first] + low[owner] - pad
        yield first, last, marks.cumsum(axis=1)[:, :-1] > 0, top, frame_y, left[owner] - pad
        first = last


def boundary_band(runs: DataFrame, height: int, width: int, distance: int = 2,
                  keys: Sequence[str] = MASK) -> DataFrame:
    """Dilation minus erosion with a (2d+1) square; outside the frame counts as set for the erosion.

    Needs the neighbourhood of one mask only: its runs travel as arrays, whole batches of masks
    are handled by array shifts.
    """
    pad = 2 * distance

    @F.pandas_udf(_RUNS)
    def band(y: pd.Series, x0: pd.Series, x1: pd.Series) -> pd.Series:
        out: list = [None] * len(y)
        for first, last, img, top, fy, fx in mask_canvases(y, x0, x1, pad):
            cols = fx[:, None] + np.arange(img.shape[1])
            inside = (cols >= 0) & (cols < width) & (fy >= 0)[:, None] & (fy < height)[:, None]
            grown, kept = img.copy(), img | ~inside
            for axis in (0, 1):
                g, k = grown.copy(), kept.copy()
                for d in range(1, distance + 1):
                    for s in (-d, d):
                        g |= np.roll(grown, s, axis)
                        k &= np.roll(kept, s, axis)
                grown, kept = g, k
            edge = np.diff(np.pad((grown & ~kept & inside).astype(np.int8), ((0, 0), (1, 1))), axis=1)
            ry, ra = np.nonzero(edge == 1)
            rb = np.nonzero(edge == -1)[1]
            rows = list(zip(fy[ry].tolist(), (ra + fx[ry]).tolist(), (rb + fx[ry]).tolist()))
            cut_ = np.searchsorted(ry, top)
            for i in range(first, last):
                out[i] = rows[cut_[i - first]:cut_[i - first + 1]]
        return pd.Series(out)

    lists = runs.groupBy(*keys).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("r"))
    drawn = lists.select(*keys, F.explode(band("r.y", "r.x0", "r.x1")).alias("b"))
    return tile_runs(drawn.select(*keys, "b.y", "b.x0", "b.x1"))


def boundary_inner(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Mask minus its 4-neighbour erosion; outside the frame counts as unset."""
    at = [*keys, "y"]
    core = runs.selectExpr(*keys, "y", "x0 + 1 as x0", "x1 - 1 as x1").where("x0 < x1")
    for step in (-1, 1):
        other = runs.selectExpr(*keys, f"y + {step} as y", "x0 as _b0", "x1 as _b1")
        core = (
            core.join(other, at)
            .where("x0 < _b1 AND _b0 < x1")
            .selectExpr(*at, "greatest(x0, _b0) as x0", "least(x1, _b1) as x1")
        )
    # A mask with a missing key has no core either way, and plain equality leaves masks where they lie.
    return difference_runs(runs, tile_runs(core), keys, on=keys, null_keys=False)


def crop_window(runs: DataFrame, windows: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Runs inside a window of ``size`` around ``(center_x, center_y)``, in window coordinates.

    Windows may reach over the frame; what is outside is empty.
    """
    win = windows.withColumn("_wx", F.expr("cast(center_x - size div 2 as int)")).withColumn(
        "_wy", F.expr("cast(center_y - size div 2 as int)")
    )
    hit = runs.join(win, list(keys)).where("y >= _wy AND y < _wy + size AND x0 < _wx + size AND x1 > _wx")
    return hit.select(
        *keys,
        F.expr("cast(y - _wy as int)").alias("y"),
        F.expr("cast(greatest(x0, _wx) - _wx as int)").alias("x0"),
        F.expr("cast(least(x1, _wx + size) - _wx as int)").alias("x1"),
    )


def window_fraction(runs: DataFrame, box: tuple[int, int, int, int], keys: Sequence[str] = MASK) -> DataFrame:
    """Pixels of each mask inside and outside one box (y0, x0, y1, x1)."""
    y0, x0, y1, x1 = box
    inside = F.expr(
        f"case when y >= {y0} and y < {y1} then greatest(0, least(x1, {x1}) - greatest(x0, {x0})) else 0 end"
    ).cast("long")
    agg = runs.groupBy(*keys).agg(
        F.sum(inside).alias("inside_px"), F.sum(F.expr("cast(x1 - x0 as bigint)")).alias("total_px")
    )
    return agg.select(
        *keys,
        "inside_px",
        (F.col("total_px") - F.col("inside_px")).alias("outside_px"),
        (F.col("inside_px") / F.col("total_px")).alias("inside_frac"),
        ((F.col("total_px") - F.col("inside_px")) / F.col("total_px")).alias("outside_frac"),
        (F.col("inside_px") == F.col("total_px")).alias("fully_inside"),
    )
