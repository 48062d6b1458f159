"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star edges.

A text's set are its distinct shingles of five words. Equal sets are merged first, so a group of
copies is one node. Each set is hashed once: the hash range is cut into bins, a bin keeps its smallest
hash, and an empty bin borrows from the filled bin of smallest priority in its own random order.
Bands of bins are bucket keys. A bucket sends out edges from one centre to its members only; every
edge is confirmed on the full sets. Buckets whose members still lie in several components get more
centres (the most shared members first, then drawn ones) until a round confirms no further link. What
is left in buckets of more members is then compared exactly: every pair of two components in one bucket,
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from maskwright.llm.common import (
    U64, in_small_batches, list_array, lower_ascii, mix, packed, ranges, sent_if_small, signed, span_hashes, text_bytes, text_slices, unpacked, word_bounds,
)
from maskwright.operators.match import connected_components
from maskwright.session import cut

WORDS = 5
BANDS, ROWS = 40, 5
#: A pair is linked when PART * intersection >= SHARE * union.
PART, SHARE = 100, 75
CENTRES = 4
#: Members of one centre that are compared in one run of rows.
RUN = 256
#: Shingles of a block of members (about), and the sets and columns of a block that are multiplied at once.
BLOCK, TILE, COLUMNS = 1 << 20, 256, 8192

_TURN = mix(np.arange(1, 65, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def shingles(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. Fewer words than a shingle: the whole
    sequence as one; no words: empty."""
    data = lower_ascii(data)
    starts, ends, own = word_bounds(data, bounds)
    h = span_hashes(data, starts, ends)
    n = np.diff(own)
    sums = np.zeros(len(h), U64)
    for k in range(words):
        sums[: len(h) - k] += h[k:] * _TURN[k]
    short = np.flatnonzero((n > 0) & (n < words))
    for d in short:
        part = h[own[d] : own[d + 1]]
        sums[own[d] : own[d] + 1] = (part * _TURN[: len(part)]).sum(dtype=U64)
        sums[own[d] : own[d] + 1] += _TURN[63 - len(part)]
    counts = np.where(n >= words, n - words + 1, n > 0)
    values = mix(sums[ranges(own[:-1], counts)])
    cuts = np.append(0, np.cumsum(counts))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        v = np.sort(values[a:b])
        out.append(v[np.append(True, v[1:] != v[:-1])] if len(v) > 1 else v)
    return out


def _priorities(bins: int) -> np.ndarray:
    i = np.arange(bins * bins, dtype=U64)
    return (mix(i + U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32).reshape(bins, bins)


def signatures(sets: list[np.ndarray], bins: int, priorities: np.ndarray) -> np.ndarray:
    """One-permutation signature of each set; an empty set has zeros."""
    out = np.zeros((len(sets), bins), U64)
    for row, u in zip(out, sets, strict=True):
        if not len(u):
            continue
        b = (((u >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))  # u is sorted, and so are the bins
        filled = b[first]
        row[filled] = u[first]
        if len(filled) < bins:
            free = np.ones(bins, bool)
            free[filled] = False
            empty = np.flatnonzero(free)
            row[empty] = row[filled[priorities[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows) * _TURN[:rows]
    return mix(parts.sum(axis=2, dtype=U64) + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n`` (set size), a 128-bit fingerprint ``f1, f2`` of the set, and its ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        priorities = _priorities(bands * rows)
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingles(*text_bytes(part.column("text")))
                n = np.array([len(s) for s in sets], np.int64)
                prints = [np.array([mix(s ^ seed).sum(dtype=U64) for s in sets], U64) for seed in (_TURN[40], _TURN[41])]
                some = n > 0
                keys = band_keys(signatures([s for s in sets if len(s)], bands * rows, priorities), bands, rows)
                lists = list_array(signed(keys.ravel()), np.append(0, np.cumsum(some * bands)), pa.int64())
                columns = [part.column("doc_id"), pa.array(n), *[pa.array(signed(p)) for p in prints], lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def confirm(edges: DataFrame, docs: DataFrame, part: int = PART, share: int = SHARE) -> DataFrame:
    """The edges (``centre, member``) whose full sets reach the similarity, as ``u, v``.

    Texts are fetched by id, a centre once for every ``RUN`` of its members, and come sorted so
    that a task holds one centre at a time.
    """
    sizes = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(RUN)).cast("int").alias("runs"))
    dealt = edges.join(sizes, "centre").withColumn("run", F.pmod(F.xxhash64("member"), F.col("runs")))
    wanted = cut(dealt.select("centre", "run", F.lit(1).alias("role"), F.col("member").alias("doc_id")).union(
        dealt.select("centre", "run").distinct().select("centre", "run", F.lit(0).alias("role"), F.col("centre").alias("doc_id"))
    ))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(sent_if_small(wanted), "doc_id")
    texts = texts.repartition("centre", "run").sortWithinPartitions("centre", "run", "role", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for batch in batches:
            for rows in text_slices(batch, "text"):
                sets = shingles(*text_bytes(rows.column("text")))
                us, vs = [], []
                names = zip(*(rows.column(c).to_pylist() for c in ("centre", "run", "role", "doc_id")), strict=True)
                for own, (centre, nth, role, doc) in zip(sets, names, strict=True):
                    if key != (centre, nth):
                        key, centres = (centre, nth), []
                    if role == 0:
                        if not any(np.array_equal(own, c) for c in centres):  # an id may stand on several texts
                            centres.append(own)
                    elif any(linked(c, own, part, share) for c in centres):
                        us.append(centre)
                        vs.append(doc)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return texts.select("centre", "run", "role", "doc_id", "text").mapInArrow(run, "u bigint, v bigint")


def linked(a: np.ndarray, b: np.ndarray, part: int = PART, share: int = SHARE) -> bool:
    if not len(a) or not len(b) or part * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return part * inter >= share * (len(a) + len(b) - inter)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    values, times = np.unique(np.concatenate([*left, *right]), return_counts=True)
    values = values[times > 1]  # sets are distinct, so what stands once is shared by none
    sides = []
    for sets in (left, right):
        h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(values, h)
        hit = np.flatnonzero(at < len(values))
        hit = hit[values[at[hit]] == h[hit]]
        order = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[order], of[order], len(sets)))
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(values), COLUMNS):
        dense = []
        for at, of, n in sides:
            some = slice(*np.searchsorted(at, (low, low + COLUMNS)))
            m = np.zeros((n, min(COLUMNS, len(values) - low)), np.float32)
            m[of[some], at[some] - low] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def joining_links(left: list[tuple], right: list[tuple] | None, part: int = PART, share: int = SHARE) -> list[tuple[int, int]]:
    """Links between members ``(id, label, set)`` of ``left`` and ``right`` (null: of ``left`` among themselves) that
    lie in different components; of links that join the same components one is enough."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    out = []
    left = sorted((m for m in left if len(m[2])), key=lambda m: len(m[2]))
    alone = right is None
    right = left if alone else sorted((m for m in right if len(m[2])), key=lambda m: len(m[2]))
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        n_a = np.array([len(m[2]) for m in a])[:, None]
        for j in range(i if alone else 0, len(right), TILE):
            b = right[j : j + TILE]
            n_b = np.array([len(m[2]) for m in b])[None]
            roots = [np.array([root(m[1]) for m in side]) for side in (a, b)]
            may = (part * np.minimum(n_a, n_b) >= share * np.maximum(n_a, n_b)) & (roots[0][:, None] != roots[1][None])
            if not may.any():
                continue
            inter = shared_counts([m[2] for m in a], [m[2] for m in b])
            for x, y in zip(*np.nonzero(may & (part * inter >= share * (n_a + n_b - inter))), strict=True):
                u, v = root(a[x][1]), root(b[y][1])
                if u != v:
                    above[max(u, v)] = min(u, v)
                    out.append((a[x][0], b[y][0]))
    return out


def settle(buckets: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, part: int = PART, share: int = SHARE) -> DataFrame:
    """Links ``u, v`` between different components of every bucket the rounds of centres have left open.

    Buckets of ``CENTRES`` + 1 members at most are tested in full by one round. Of the others every pair of
    two components is compared: the members of a bucket's largest component stand on one side, all others
    on the other side and among themselves, both dealt to blocks of about ``BLOCK`` shingles. Buckets of the
    same members are compared once.
    """
    open_ = _unsettled(buckets, components).where(F.col("n") > CENTRES + 1).distinct()
    same = open_.groupBy("key").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("print"), F.sum(F.hash("rep").cast("bigint")).alias("more"), F.first("n").alias("n"))
    once = same.groupBy("print", "more", "n").agg(F.min("key").alias("key")).select("key")
    sizes = classes.groupBy(F.col("rep")).agg(F.sum("n").alias("size"))
    open_ = cut(open_.join(once, "key", "left_semi").join(sizes, "rep").select("key", "rep", "label", "size"))
    largest = open_.groupBy("key", "label").agg(F.sum("size").alias("size")).groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("home"))
    rest = F.col("label") != F.col("home")
    dealt = open_.join(largest, "key")
    runs = dealt.groupBy("key").agg(*[
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(side, F.col("size")).otherwise(0)) / F.lit(BLOCK))).cast("int").alias(name) for name, side in (("homes", ~rest), ("rests", rest))])
    dealt = dealt.join(runs, "key").withColumn("rest", rest)
    dealt = dealt.withColumn("run", F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("homes"))).cast("int"))

    def place(i: str, j: str, among: bool, side: str) -> str:
        return f"struct({i} AS i, {j} AS j, {among} AS among, {side} AS side)"

    # The places of a member: home block against rest block, and rest block against rest block.
    against = F.expr(f"transform(sequence(0, rests - 1), x -> {place('run', 'x', False, '0')})")
    others = F.expr(f"concat(transform(sequence(0, homes - 1), x -> {place('x', 'run', False, '1')}),"
                    f" transform(sequence(0, rests - 1), x -> {place('least(x, run)', 'greatest(x, run)', True, 'IF(run > x, 1, 0)')}))")
    wanted = dealt.select("key", "label", F.col("rep").alias("doc_id"), F.explode(F.when(F.col("rest"), others).otherwise(against)).alias("p"))
    wanted = cut(wanted.select("key", "p.among", "p.i", "p.j", "p.side", "label", "doc_id"))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(sent_if_small(wanted), "doc_id")
    names = ["key", "among", "i", "j", "side", "label", "doc_id"]
    texts = texts.select(*names, "text").repartition(*names[:4]).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            links = joining_links(sides[0], None if own[1] and own[2] == own[3] else sides[1], part, share)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for rows in text_slices(batch, "text"):
                sets = shingles(*text_bytes(rows.column("text")))
                for own_set, (*key, side, label, doc) in zip(sets, zip(*(rows.column(c).to_pylist() for c in names), strict=True), strict=True):
                    if key != own:
                        if own is not None:
                            yield done()
                        own, sides = key, ([], [])
                    sides[side].append((doc, label, own_set))
        if own is not None:
            yield done()

    return texts.mapInArrow(run, "u bigint, v bigint")


def _unsettled(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """``key, rep, label, n``: members, their components and the size of each bucket with several components."""
    labelled = buckets.join(components, buckets["rep"] == components["node"], "left")
    labelled = labelled.select("key", "rep", F.coalesce("component", "rep").alias("label"))
    spread = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    return labelled.join(spread.where("lo < hi"), "key").select("key", "rep", "label", "n")


def _more_edges(buckets: DataFrame, components: DataFrame, tested: DataFrame, nth: int) -> DataFrame:
    """Edges from up to ``CENTRES`` centres of each unsettled bucket to its members in other components."""
    open_ = cut(_unsettled(buckets, components))
    if nth == 1:
        shared = open_.groupBy("rep").agg(F.sum("n").alias("shared"))
        ranked, order = open_.join(shared, "rep"), [F.desc("shared"), F.col("rep")]
    else:
        ranked, order = open_, [F.xxhash64(F.lit(nth), "rep"), F.col("rep")]
    place = F.row_number().over(W.partitionBy("key").orderBy(*order))
    centres = ranked.withColumn("place", place).where(F.col("place") <= CENTRES).select("key", F.col("rep").alias("centre"), F.col("label").alias("own"))
    pairs = open_.join(centres, "key").where("label <> own").select("centre", F.col("rep").alias("member"))
    pairs = pairs.withColumns({"a": F.least("centre", "member"), "b": F.greatest("centre", "member")})
    pairs = pairs.join(tested, ["a", "b"], "left_anti")
    return cut(pairs.groupBy("a", "b").agg(F.min("centre").alias("centre")).select(
        "centre", (F.col("a") + F.col("b") - F.col("centre")).alias("member")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", part: int = PART, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable by links, ``kept`` marks the row of that id. Texts
    that are null or without words have size 0 and are linked with nothing. Rows without id are
    linked with nothing either: ``component_id`` is null and they are kept. Rows that repeat an id
    are one document whose links are those of all its texts.
    """
    docs = in_small_batches(docs).select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = cut(sketches(docs))
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    chosen = some.join(classes.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "n", "doc_id"], "left_semi")
    banded = chosen.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("far")).where("centre < far")
    buckets = cut(banded.join(shared.select("key", "centre"), "key"))
    edges = cut(buckets.where("rep <> centre").select("centre", F.col("rep").alias("member")).distinct())
    repeated = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id")
    same = some.join(repeated, "doc_id", "left_semi").join(classes, ["f1", "f2", "n"]).where("doc_id <> rep")
    links = cut(confirm(edges, docs, part, share).union(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))).distinct())
    as_pair = (F.least("centre", "member").alias("a"), F.greatest("centre", "member").alias("b"))
    tested, nth = edges.select(*as_pair), 0
    while True:
        components, nth = cut(connected_components(links)), nth + 1
        edges = _more_edges(buckets, components, tested, nth)
        new = cut(confirm(edges, docs, part, share).distinct()) if not edges.isEmpty() else None
        if new is None or new.isEmpty():
            break
        links, tested = links.union(new), tested.union(edges.select(*as_pair))
    new = cut(settle(buckets, components, classes, docs, part, share))
    if not new.isEmpty():
        components = cut(connected_components(links.union(new)))
    named = classes.join(components, classes["rep"] == components["node"], "left")
    named = cut(named.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id")))
    out = rows.drop("bands").join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of every component, and all rows without id.

    Of rows that repeat the id of a kept document one stays.
    """
    ids = near_duplicates(docs, key, text).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    ids = ids.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")).where("NOT kept OR times > 1")
    ids = cut(ids)
    rows = packed(docs, key).withColumnRenamed(key, "key")
    often = ids.where("kept")
    out = rows.join(sent_if_small(ids.select("id")), F.col("key") == F.col("id"), "left_anti")
    if not often.isEmpty():
        again = rows.join(sent_if_small(often.select("id")), F.col("key") == F.col("id"), "left_semi")
        out = out.union(again.dropDuplicates(["key"]))
    return unpacked(out)
