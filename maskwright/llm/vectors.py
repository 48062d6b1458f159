"""Near-duplicate embeddings: products of int8 tiles with a proven error bound, exact recomputation where needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.operators.match import connected_components
from maskwright.session import cut

COSINE = 0.95
#: Vectors of a block (expected number) and rows of a tile inside a task.
BLOCK, TILE = 8192, 1024
#: Pairs that are recomputed at once.
RECHECK = 1 << 15


def usable(vector: str, zero: bool = False) -> Column:
    """True for vectors without null or non-finite components, and unless ``zero`` not all zero."""
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    fine = fine if zero else fine & F.exists(c, lambda x: x != 0)
    return F.coalesce(fine & (F.size(c) > 0), F.lit(False))


def to_matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors u (double), their int8 codes q, scales s, and the exact error lengths |u - s q|."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    return u, q, s, np.linalg.norm(u - s[:, None] * q, axis=1)


class Forest:
    """Components of numbered nodes by smallest label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def tile_links(u, q, s, eps, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between two tiles of row numbers (pairs a < b only).

    With u = s q + e the cosine differs from s s' (q q') by at most |e| |s' q'| + |s q| |e'| + |e| |e'|,
    and |s q| <= 1 + |e|. The product q q' is exact: int8 codes in single precision up to length 1040,
    in double beyond.
    """
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    dots = q[left].astype(kind) @ q[right].astype(kind).T
    dots *= s[left].astype(kind)[:, None]
    dots *= s[right].astype(kind)
    worst_l, worst_r = eps[left].max(), eps[right].max()
    slack = worst_l * (1 + worst_r) + (1 + worst_l) * worst_r + worst_l * worst_r + 1e-5
    i, j = np.nonzero(dots >= cosine - slack)
    a, b = left[i], right[j]
    bound = eps[a] * (1 + eps[b]) + (1 + eps[a]) * eps[b] + eps[a] * eps[b] + 1e-5
    maybe = (a < b) & (dots[i, j] >= cosine - bound)
    a, b = a[maybe], b[maybe]
    sure = np.zeros(len(a), bool)
    for at in range(0, len(a), RECHECK):
        part = slice(at, at + RECHECK)
        sure[part] = np.einsum("ij,ij->i", u[a[part]], u[b[part]]) >= cosine
    return a[sure], b[sure]


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Equal vectors form one class with a count, so a group of copies is compared once. Classes are
    dealt by hash to blocks of about ``block``; every pair of blocks is one group of at most two blocks,
    worked off tile by tile. A group gives per class the number of linked vectors and one edge
    to its component inside the group, never its pairs. Only vectors of one length are compared.
    Vectors that are null, empty, zero or hold null or non-finite components have no links
    and are their own component. A row without id has no links, a null component, and is kept; it
    counts as nobody's link. Rows that repeat an id are vectors of their own; their ids share a component.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    rows = rows.withColumn("ok", usable("v") & F.col("vec_id").isNotNull())
    hashed = {"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(17), "v"))}
    rows = rows.withColumns(hashed)
    classes = rows.where("ok").groupBy("h1", "h2", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("dim", F.size("v")))
    blocks = max(1, -(-classes.count() // block))
    own = F.pmod(F.col("h1"), F.lit(blocks)).cast("int")
    copies = classes.select("*", own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    copies = copies.select("h1", "h2", "v", "rep", "n", "dim", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), (F.col("b") > F.col("other")).alias("second"))

    def run(table: pa.Table) -> pa.Table:
        u, q, s, eps = quantise(to_matrix(table.column("v")))
        weight, ids = table.column("n").to_numpy(), table.column("rep").to_numpy()
        second = table.column("second").to_numpy()
        within = table.column("lo")[0] == table.column("hi")[0]
        order = np.arange(len(u)) if within else np.argsort(second, kind="stable")
        u, q, s, eps, weight, ids = u[order], q[order], s[order], eps[order], weight[order], ids[order]
        first = len(u) if within else int((~second).sum())
        count, forest = np.zeros(len(u), np.int64), Forest(len(u))
        lefts = [np.arange(x, min(x + TILE, first)) for x in range(0, first, TILE)]
        rights = lefts if within else [np.arange(x, min(x + TILE, len(u))) for x in range(first, len(u), TILE)]
        for left in lefts:
            for right in rights:
                if within and right[0] < left[0]:
                    continue
                a, b = tile_links(u, q, s, eps, left, right, cosine)
                count += np.bincount(a, weight[b], len(u)).astype(np.int64) + np.bincount(b, weight[a], len(u)).astype(np.int64)
                forest.join(a, b)
        got = np.flatnonzero(count)
        h1, h2 = (table.column(c).to_numpy()[order][got] for c in ("h1", "h2"))
        return pa.table({"h1": h1, "h2": h2, "links": count[got], "u": ids[got], "v": ids[forest.label[got]]})

    found = copies.groupBy("dim", "lo", "hi").applyInArrow(run, "h1 bigint, h2 bigint, links bigint, u bigint, v bigint")
    found = cut(found)
    chosen = rows.where("ok").select("h1", "h2", F.col("vec_id").alias("u"))
    repeated = chosen.groupBy("u").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("u")
    same = chosen.join(repeated, "u", "left_semi").join(classes.select("h1", "h2", F.col("rep").alias("v")), ["h1", "h2"]).select("u", "v")
    components = connected_components(found.select("u", "v").union(same))
    totals = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "rep", "n").join(totals, ["h1", "h2"], "left").join(components, F.col("rep") == F.col("node"), "left")
    named = cut(named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
