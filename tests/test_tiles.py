"""64-bit tile rows against dense arrays: full rows, tile borders, both sign bits."""

import numpy as np
import pytest

from maskwright.operators import tiles as B

SIDE = 200


def drawn(seed, masks):
    rng = np.random.default_rng(seed)
    out = {}
    for inst in range(masks):
        m = np.zeros((SIDE, SIDE), bool)
        for _ in range(3):
            y, x, h, w = rng.integers(0, 150), rng.integers(0, 150), rng.integers(1, 50), rng.integers(1, 140)
            m[y : y + h, x : x + w] = rng.random((min(h, SIDE - y), min(w, SIDE - x))) < 0.9
        out[inst] = m
    out[masks] = np.ones((SIDE, SIDE), bool)  # whole tiles
    out[masks + 1] = np.zeros((SIDE, SIDE), bool)
    out[masks + 1][:, [63, 64, 127, 128]] = True  # both sides of every border
    return out


def run_rows(masks):
    rows = []
    for inst, m in masks.items():
        for y, row in enumerate(m):
            edge = np.diff(np.concatenate([[0], row.astype(int), [0]]))
            rows += [(1, inst, y, int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return rows


@pytest.fixture(scope="module")
def sides(spark):
    schema = "image_id long, inst_id long, y int, x0 int, x1 int"
    a, b = drawn(1, 4), {k: v for k, v in drawn(2, 3).items() if k < 3}
    return a, b, spark.createDataFrame(run_rows(a), schema), spark.createDataFrame(run_rows(b), schema)


def dense(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.inst_id, np.zeros((SIDE, SIDE), bool))[r.y, r.x0 : r.x1] = True
    return out


def test_there_and_back(sides):
    a, _, ra, _ = sides
    rows = B.tile_rows(ra)
    got = dense(B.runs_of(rows))
    assert all((got[k] == m).all() for k, m in a.items())
    assert {r.inst_id: r.area for r in B.bit_areas(rows).collect()} == {k: int(m.sum()) for k, m in a.items()}


def test_counts_of_two_sides(sides):
    a, b, ra, rb = sides
    del a[4]
    ra = ra.where("inst_id <> 4")
    one, two = np.any(list(a.values()), axis=0), np.any(list(b.values()), axis=0)
    got = B.side_counts(ra, rb).first()
    assert (got.both, got.only_a, got.only_b) == ((one & two).sum(), (one & ~two).sum(), (two & ~one).sum())
    union = B.tile_rows(rb, ["image_id"])
    shared = {r.inst_id: r.inter for r in B.shared_bits(B.tile_rows(ra), union).collect()}
    assert shared == {k: int((m & two).sum()) for k, m in a.items() if (m & two).any()}
    left = dense(B.runs_of(B.without(B.tile_rows(ra), union)))
    assert all((left.get(k, np.zeros_like(m)) == (m & ~two)).all() for k, m in a.items())
    a[4] = np.ones((SIDE, SIDE), bool)


def test_inner_boundary(sides):
    a, _, ra, _ = sides
    got = dense(B.runs_of(B.inner_boundary(B.tile_rows(ra))))
    for k, m in a.items():
        p = np.pad(m, 1)
        core = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
        assert (got[k] == (m & ~core)).all()


def test_nothing(spark):
    none = spark.createDataFrame([], "image_id long, inst_id long, y int, x0 int, x1 int")
    assert B.runs_of(B.inner_boundary(B.tile_rows(none))).count() == B.side_counts(none, none).count() == 0
