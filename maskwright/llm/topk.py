"""Exact top-k by inner product: a ball tree per shard, searched best bound first with the k-th score shared."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from maskwright.llm.vectors import to_matrix, usable
from maskwright.session import cut

K = 10
SCALE = 1024
#: Expected rows of a shard, of a block of queries; most rows of a leaf.
SHARD, QUERIES, LEAF = 8192, 1024, 128


class BallTree:
    """Nodes as arrays: centre, radius, rows (a range of ``order``) and children (or -1)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.centres, self.radii, self.spans, self.children = [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.radii)
            if parent >= 0:
                self.children[parent][side] = node
            rows = x[self.order[a:b]]
            centre = rows.mean(axis=0)
            away = np.linalg.norm(rows - centre, axis=1)
            self.centres.append(centre)
            self.radii.append(away.max())
            self.spans.append((a, b))
            self.children.append([-1, -1])
            if b - a > leaf and away.max() > 0:
                one = rows[int(away.argmax())]
                two = rows[int(np.linalg.norm(rows - one, axis=1).argmax())]
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows @ (two - one), half)]
                todo += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scores) of the k best rows that reach its floor, ties by smaller id.

    A node's rows score at most q·centre + |q| radius; nodes are opened in the order of that bound, until it
    is below the k-th score found so far or known from elsewhere. Sums are exact: in double precision
    where they stay below 2^53, as whole numbers of any size otherwise.
    """
    big = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * x.shape[1] >= 2.0**53
    xs = x.astype(object) if big else x.astype(np.float64)
    qs = queries.astype(object) if big else queries.astype(np.float64)
    length = np.linalg.norm(queries.astype(np.float64), axis=1)
    reach = length[:, None] * tree.radii
    bounds = queries.astype(np.float64) @ tree.centres.T + reach
    bounds += 1e-9 * (np.abs(bounds) + reach + length[:, None] * np.linalg.norm(tree.centres, axis=1)) + 1e-6
    out = []
    for i, q in enumerate(qs):
        kth, scores, names = floors[i], np.zeros(0, xs.dtype), np.zeros(0, np.int64)
        heap = [(-bounds[i, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            low, high = tree.children[node]
            if low >= 0:
                for child in (low, high):
                    if bounds[i, child] >= kth:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            a, b = tree.spans[node]
            rows = tree.order[a:b]
            got = xs[rows] @ q
            take = (got >= kth) & (ids[rows] != own[i])
            if take.any():
                scores, names = np.concatenate([scores, got[take]]), np.concatenate([names, ids[rows[take]]])
                best = np.lexsort((names, -scores))[:k]
                scores, names = scores[best], names[best]
                if len(scores) == k:
                    kth = max(kth, float(scores[-1])) if not big else max(kth, scores[-1])
        out.append((names, scores))
    return out


def _searched(groups: DataFrame, k: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        x, role, ids = to_matrix(table.column("v")), table.column("query").to_numpy(), table.column("vec_id").to_numpy()
        q, c = np.flatnonzero(role), np.flatnonzero(~role)
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        if not len(q) or not len(c):
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        floors = table.column("floor").to_pylist()
        floors = [-np.inf if floors[i] is None else floors[i] for i in q]
        found = search(BallTree(x[c].astype(np.float64)), x[c], ids[c], x[q], ids[q], floors, k)
        sizes = [len(n) for n, _ in found]
        scores = [max(-(2**63), min(2**63 - 1, int(s))) for _, row in found for s in row]
        return pa.table({"query_id": np.repeat(ids[q], sizes), "vec_id": np.concatenate([n for n, _ in found]), "score": pa.array(scores, pa.int64())})

    return groups.groupBy("dim", "shard", "block").applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` rows of largest integer inner product.

    Components count as floor(scale * x). Rows are dealt by hash to shards of about ``shard``, queries
    to blocks of about ``block``; a group is one shard with one block. Every block first searches one
    shard; the k-th scores found there are the floors of its queries in all other shards. Own id
    excluded; ties go to the smaller id. Vectors that are null, empty or hold null or non-finite
    components, or have no id, take no part; zero vectors do. Only vectors of one length meet. Rows that repeat
    an id are candidates of their own; equal queries of one id are one query. Fewer than ``k`` rows: all of them. Scores
    beyond the range of a long are given as its limits, ranked by their true size inside a shard.
    """
    def whole(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
        df = df.where(usable("v", zero=True) & F.col("vec_id").isNotNull())
        return df.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("v"))

    rows, asked = cut(whole(vectors)), cut(whole(queries).distinct())
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, shard), (asked, block)))
    dealt = rows.withColumns({"dim": F.size("v"), "shard": F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")})
    asked = asked.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")})
    each_block, each_shard = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, shards))
    candidates = dealt.select("dim", "shard", each_block.alias("block"), F.lit(False).alias("query"), F.lit(None).cast("double").alias("floor"), "vec_id", "v")
    wanted = asked.select("dim", each_shard.alias("shard"), "block", F.lit(True).alias("query"), F.lit(None).cast("double").alias("floor"), "vec_id", "v")
    home = F.col("shard") == F.col("block") % F.lit(shards)
    near = cut(_searched(candidates.where(home).union(wanted.where(home)), k))
    found = near
    if shards > 1:
        floors = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        lifted = wanted.where(~home).drop("floor").join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        lifted = lifted.select("dim", "shard", "block", "query", F.col("least").cast("double").alias("floor"), "vec_id", "v")
        found = near.union(_searched(candidates.where(~home).union(lifted), k))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
