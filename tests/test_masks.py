"""Mask algebra, shapes and matching against dense arrays on small random frames."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import layers, match, runs as R, score, shape
from maskwright.plans import history
from maskwright.sources import masks as enc

H = W = 40


def blobs(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        m = np.zeros((H, W), bool)
        for _ in range(rng.integers(1, 4)):
            y, x, h, w = rng.integers(0, 34), rng.integers(0, 34), rng.integers(1, 12), rng.integers(1, 12)
            m[y:y + h, x:x + w] = True
        m &= rng.random((H, W)) > 0.05
        m[rng.integers(0, H), rng.integers(0, W)] = True
        out.append(m)
    return out


def rows_of(img, *key):
    out = []
    for y in range(img.shape[0]):
        edge = np.diff(np.r_[0, img[y].astype(int), 0])
        out += [(*key, y, int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return out


def table(spark, groups):
    rows = [r for (image, inst), m in groups.items() for r in rows_of(m, image, inst)]
    return spark.createDataFrame(rows, "image_id long, inst_id long, y int, x0 int, x1 int")


def dense(df, keys=("image_id", "inst_id")):
    out = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        img = out.setdefault(key, np.zeros((H, W), bool))
        assert not img[r.y, r.x0:r.x1].any()
        img[r.y, r.x0:r.x1] = True
    return out


@pytest.fixture(scope="module")
def data(spark):
    a = {(i, j): m for i in range(3) for j, m in enumerate(blobs(i, 5), 1)}
    b = {(i, j): m for i in range(3) for j, m in enumerate(blobs(10 + i, 6), 1)}
    return a, b, table(spark, a).cache(), table(spark, b).cache()


def test_overlap_and_areas(data):
    a, b, ra, rb = data
    got = {(r.image_id, r.pred_id, r.gt_id): (r.inter, r.union_px) for r in match.overlap_pairs(ra, rb).collect()}
    want = {(i, p, g): (int((m & n).sum()), int((m | n).sum())) for (i, p), m in a.items() for (k, g), n in b.items() if i == k and (m & n).any()}
    assert got == want


def test_union_difference_paint(data):
    a, _, ra, _ = data
    union = dense(R.union_runs(ra), ("image_id",))
    for i in range(3):
        assert (union[(i,)] == np.any([a[i, j] for j in range(1, 6)], axis=0)).all()
    odd = R.union_runs(ra.where("inst_id % 2 = 1"))
    left = dense(R.difference_runs(ra.where("inst_id % 2 = 0"), odd))
    cover = {i: a[i, 1] | a[i, 3] | a[i, 5] for i in range(3)}
    for (i, j), m in left.items():
        assert (m == (a[i, j] & ~cover[i])).all()
    painted = dense(R.paint(ra, F.col("inst_id")))
    for i in range(3):
        canvas = np.zeros((H, W), int)
        for j in range(1, 6):
            canvas[a[i, j]] = j
        for j in range(1, 6):
            assert (painted.get((i, j), np.zeros((H, W), bool)) == (canvas == j)).all()


def test_stream_first(spark, data):
    a, _, ra, _ = data
    typed = ra.withColumn("type_label", F.when(F.col("inst_id").isin(2, 4), "streams").otherwise("satellites"))
    painted, ids = layers.paint_stream_first(typed)
    got, label = dense(painted), {(r.image_id, r.inst_id): r.label_id for r in ids.collect()}
    for i in range(3):
        canvas, n, want = np.zeros((H, W), int), 0, {}
        for j in (2, 4, 1, 3, 5):
            m = a[i, j] if j in (2, 4) else a[i, j] & (canvas == 0)
            if m.any():
                n += 1
                canvas[m], want[j] = j, n
        assert {j: label[i, j] for j in want} == want
        for j in range(1, 6):
            assert (got.get((i, j), np.zeros((H, W), bool)) == (canvas == j)).all()


def test_boundaries(data):
    a, _, ra, _ = data
    inner, band = dense(R.boundary_inner(ra)), dense(R.boundary_band(ra, H, W))
    for key, m in a.items():
        p = np.pad(m, 1)
        core = m & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
        assert (inner[key] == (m & ~core)).all()
        grown, kept = np.zeros_like(m), np.ones_like(m)
        q0, q1 = np.pad(m, 2), np.pad(m, 2, constant_values=True)
        for dy, dx in itertools.product(range(5), range(5)):
            grown |= q0[dy:dy + H, dx:dx + W]
            kept &= q1[dy:dy + H, dx:dx + W]
        assert (band[key] == (grown & ~kept)).all()


def flood(img, eight):
    lab, n = np.zeros(img.shape, int), 0
    for y, x in zip(*np.nonzero(img)):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            cy, cx = todo.pop()
            for dy, dx in itertools.product((-1, 0, 1), (-1, 0, 1)):
                if (dy or dx) and (eight or not (dy and dx)):
                    ny, nx = cy + dy, cx + dx
                    if 0 <= ny < img.shape[0] and 0 <= nx < img.shape[1] and img[ny, nx] and not lab[ny, nx]:
                        lab[ny, nx] = n
                        todo.append((ny, nx))
    return lab, n


@pytest.mark.parametrize("eight", [True, False])
def test_clean_mask(data, eight):
    a, _, ra, _ = data
    got = dense(shape.clean_runs(ra, eight))
    for key, m in a.items():
        lab, n = flood(m, eight)
        big = lab == 1 + int(np.argmax([(lab == k).sum() for k in range(1, n + 1)]))
        outside, _ = flood(~np.pad(big, 1), False)
        assert (got[key] == ~(outside == outside[0, 0])[1:-1, 1:-1]).all()


def test_moments_hull(data):
    a, _, ra, _ = data
    asp = {(r.image_id, r.inst_id): r.aspect_sym_moment for r in shape.aspect_moment(shape.moments(ra)).collect()}
    hull = {(r.image_id, r.inst_id): r.convex_area for r in shape.convex_area(ra).collect()}
    for key, m in a.items():
        ys, xs = np.nonzero(m)
        ev = np.clip(np.linalg.eigvalsh(np.cov(np.c_[ys, xs].astype(float), rowvar=False)), 1e-12, None)
        assert asp[key] == pytest.approx(np.sqrt(ev[1] / ev[0]), rel=1e-9)
        pts = sorted({(int(x) + dx, int(y) + dy) for y, x in zip(ys, xs) for dx in (0, 1) for dy in (0, 1)})
        chain = []
        for seq in (pts, pts[::-1]):
            part = []
            for p in seq:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                    part.pop()
                part.append(p)
            chain += part[:-1]
        area = abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(chain, chain[1:] + chain[:1]))) / 2
        assert hull[key] == area


def test_hausdorff(spark, data):
    a, b, ra, rb = data
    images = spark.createDataFrame([(0,), (1,), (2,), (9,)], "image_id long")
    got = {r.image_id: r.capped_hausdorff95 for r in score.hausdorff95(ra.where("image_id <> 2"), rb, images, H, W).collect()}
    assert got[9] is None and got[2] == pytest.approx(np.hypot(H, W))
    for i in (0, 1):
        def edge(group, n):
            m = np.any([group[i, j] for j in range(1, n)], axis=0)
            p = np.pad(m, 1)
            return np.argwhere(m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])).astype(float)

        u, v = edge(a, 6), edge(b, 7)
        d = np.sqrt(((u[:, None] - v[None]) ** 2).sum(-1))
        assert got[i] == pytest.approx(max(np.percentile(d.min(1), 95), np.percentile(d.min(0), 95)))


def test_squared_distances():
    """Far and one-sided point sets, single rows and columns."""
    rng = np.random.default_rng(7)
    for n, m, ya, yb in ((50, 1, (0, 5), (400, 401)), (40, 60, (0, 90), (0, 90)), (30, 30, (300, 310), (0, 4)), (1, 80, (50, 51), (0, 200))):
        a = np.stack([rng.integers(*ya, n), rng.integers(0, 300, n)], axis=1)
        b = np.stack([rng.integers(*yb, m), rng.integers(0, 120, m)], axis=1)
        assert (score.squared_distances(a, b) == ((a[:, None] - b[None]) ** 2).sum(-1).min(1)).all()


def test_optimal_pairs_exact(spark):
    rng = np.random.default_rng(5)
    rows = []
    for image in range(40):
        for g, p in itertools.product(range(5), range(5)):
            if rng.random() < 0.6:
                rows.append((image, p, g, float(rng.random())))
    pairs = spark.createDataFrame(rows, "image_id long, pred_id long, gt_id long, iou double").cache()
    chosen = match.optimal_pairs(pairs).collect()
    total = {}
    for r in chosen:
        total[r.image_id] = total.get(r.image_id, 0) + r.iou
    assert len({(r.image_id, r.pred_id) for r in chosen}) == len(chosen) == len({(r.image_id, r.gt_id) for r in chosen})
    for image in range(40):
        w = np.zeros((5, 5))
        for i, p, g, v in rows:
            if i == image:
                w[g, p] = v
        best = max(sum(w[g, q[g]] for g in range(5)) for q in itertools.permutations(range(5)))
        assert total.get(image, 0) == pytest.approx(best)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (13, 12), (20, 21)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in match.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3)}, **{i: 10 for i in (10, 11, 12, 13)}, 20: 20, 21: 20, **{i: 100 for i in range(100, 160)}}


def test_cross_type_conflict(spark):
    def box(y, x, h, w):
        m = np.zeros((H, W), bool)
        m[y:y + h, x:x + w] = True
        return m

    streams = {(1, 1): box(0, 0, 4, 30), (1, 2): box(10, 10, 6, 6), (1, 3): box(20, 0, 4, 30)}
    sats = {(1, 1): box(2, 0, 6, 6), (1, 2): box(10, 10, 6, 7), (1, 3): box(21, 5, 2, 2)}

    def ready(group):
        df = table(spark, group)
        area = R.areas(df)
        return df.join(area, ["image_id", "inst_id"]).withColumn("solidity", F.lit(1.0)).withColumn("aspect_sym_moment", F.lit(1.1)).withColumn("curvature_ratio", F.lit(None).cast("double"))

    s, t, log = history.cross_type_conflict(ready(streams), ready(sats))
    assert {r.action: (r.stream_idx, r.sat_idx, r.overlap_px) for r in log.collect()} == {
        "trim_satellite": (1, 1, 12), "drop_stream": (2, 2, 36), "drop_satellite": (3, 3, 4)}
    assert set(dense(s)) == {(1, 1), (1, 3)}
    left = dense(t)
    assert set(left) == {(1, 1), (1, 2)} and left[1, 1].sum() == 24 and left[1, 2].sum() == 42


def test_rle_text(data):
    a, _, ra, _ = data
    text = enc.encode_rle(ra, H, W)
    back = dense(enc.decode_rle(text, H, W))
    assert all((back[k] == m).all() for k, m in a.items())
    # A 3x3 square at the origin of a 4x4 frame: runs 0 3 1 3 1 3 5.
    assert enc.counts_of(enc.counts_text(np.array([0, 3, 1, 3, 1, 3, 5]))) == [0, 3, 1, 3, 1, 3, 5]
