"""Steps whose time grew too fast (findings of round 3): results at odd inputs, and the plan that makes them fast."""

import numpy as np
import pytest


def test_runs_of_tile_rows_are_compiled(spark):
    """Runs of any 64 bits, without functions on arrays, which Spark interprets bit by bit."""
    from maskwright.operators import tiles as B

    rng = np.random.default_rng(7)
    words = [1, -1, -2 ** 63, 2 ** 63 - 1, 5, -2, 1 << 62, 0x5555555555555555, 0, *rng.integers(-2 ** 63, 2 ** 63 - 1, 200).tolist()]
    rows = spark.createDataFrame([(1, i, -3, i % 3, w) for i, w in enumerate(words)], "image_id long, inst_id long, y int, tile long, bits long")
    runs = B.runs_of(rows)
    got = {}
    for r in runs.collect():
        got.setdefault(r.inst_id, []).extend(range(r.x0 - r.tile * 64, r.x1 - r.tile * 64))
    assert {i: sorted(v) for i, v in got.items()} == {i: [k for k in range(64) if w >> k & 1] for i, w in enumerate(words) if w}
    assert "lambda" not in runs._jdf.queryExecution().executedPlan().toString()


def _flood(img, eight):
    """Components of a small image, numbered in raster order."""
    label, n = np.zeros(img.shape, int), 0
    for at in zip(*np.nonzero(img)):
        if not label[at]:
            n, todo = n + 1, [at]
            label[at] = n
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        to = (y + dy, x + dx)
                        if (eight or not (dy and dx)) and 0 <= to[0] < img.shape[0] and 0 <= to[1] < img.shape[1] and img[to] and not label[to]:
                            label[to] = n
                            todo.append(to)
    return label


@pytest.mark.parametrize("eight", [True, False])
def test_clean_masks_are_worked_on_by_batches(spark, eight):
    """Rings in rings, equal parts, overlapping, touching, empty and repeated runs, frames below zero: as by flood fill."""
    from maskwright.operators import shape

    rng, rows, images = np.random.default_rng(11), [], {}
    for inst in range(60):
        tall, wide = int(rng.integers(1, 14)), int(rng.integers(1, 90))
        img = rng.random((tall, wide)) < rng.choice([0.3, 0.5, 0.7, 0.95])
        if inst % 5 == 0:  # rings
            img = np.minimum.reduce([np.arange(tall)[:, None] + 0 * img, tall - 1 - np.arange(tall)[:, None] + 0 * img,
                                     np.arange(wide)[None] + 0 * img, wide - 1 - np.arange(wide)[None] + 0 * img]) % 3 == inst // 5 % 3
        top, left = int(rng.integers(-20, 20)), int(rng.integers(-99, 99))
        runs = [(int(y), int(x), int(min(x + rng.integers(1, 4), wide))) for y, x in zip(*np.nonzero(img))]  # ragged, overlapping
        full = np.zeros_like(img)
        for y, a, b in runs:
            full[y, a:b] = True
        if full.any():
            images[inst] = (full, top, left)
            rows += [(1, inst, y + top, a + left, b + left) for y, a, b in runs] + [(1, inst, top, left, left)] * (inst % 2)
    df = spark.createDataFrame(rows, "image_id long, inst_id long, y int, x0 int, x1 int")
    cleaned = shape.clean_runs(df, eight)
    got = {}
    for r in cleaned.where("x0 < x1").collect():
        got.setdefault(r.inst_id, set()).update((r.y, x) for x in range(r.x0, r.x1))
    for inst, (img, top, left) in images.items():
        label = _flood(img, eight)
        big = np.pad(label == 1 + int(np.argmax(np.bincount(label[label > 0])[1:])), 1)
        around = _flood(~big, False)
        want = np.argwhere(around != around[0, 0])
        assert got[inst] == {(int(y) - 1 + top, int(x) - 1 + left) for y, x in want}, inst
    assert len(got) == len(images) > 50
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan  # a call of Python for every mask


def test_shapes_are_drawn_without_sorting_pixels(spark):
    """Outlines, insides and thick lines cut by the frame; the tasks of m17 held a sort and a window per pixel."""
    from maskwright.catalog import load
    from maskwright.operators import regions as G

    box = [(-2.0, 1.0), (4.0, 1.0), (4.0, 3.0), (-2.0, 3.0)]
    rows = [(1, 1, "polygon", box), (1, 2, "line", [(5.0, 0.0), (5.0, 2.0)]), (1, 3, "line", [(69.0, 7.0), (60.0, 7.0)]), (1, 4, "line", [(90.0, 9.0), (95.0, 9.0)])]
    df = spark.createDataFrame(rows, "image_id long, inst_id long, kind string, verts array<struct<x: double, y: double>>")
    got = {}
    runs = G.rasterize_shapes(df, 8, 70).collect()
    for r in runs:
        got.setdefault(r.inst_id, set()).update((r.y, x) for x in range(r.x0, r.x1))
    assert got == {1: {(y, x) for y in (1, 2, 3) for x in range(5)}, 2: {(y, x) for y in range(4) for x in (4, 5, 6)},
                   3: {(y, x) for y in (6, 7) for x in range(59, 70)}}
    assert len(runs) == 3 + 4 + 2  # joined at tile borders
    plan = load()["m17_rasterize_shapes"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_instances_are_drawn_once_beside_the_union(spark):
    """IoU with the union, also where nothing is shared or predicted; one aggregation by instance, not two that are joined."""
    from maskwright.operators import match

    schema = "image_id long, inst_id long, y int, x0 int, x1 int"
    gt = spark.createDataFrame([(1, 1, 0, 60, 70), (1, 1, 1, 60, 70), (1, 2, 9, 0, 5), (2, 1, 0, 0, 3)], schema)
    pred = spark.createDataFrame([(1, 7, 0, 62, 66), (1, 8, 0, 64, 80), (3, 1, 0, 0, 9)], schema)
    out = match.union_vs_instances(pred, gt)
    assert sorted((r.image_id, r.gt_id, r.gt_area, r.pred_px, r.inter, r.iou) for r in out.collect()) == [
        (1, 1, 20, 18, 8, 8 / 30), (1, 2, 5, 18, 0, 0.0), (2, 1, 3, 0, 0, 0.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
