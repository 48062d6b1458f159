"""Helpers of the text operators: Arrow batches as byte arrays, word hashes, hash-based draws and folds.

Everything works on one Arrow batch (or a slice of it) at a time, so a task needs memory for a few
megabytes of text, or for its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

U64 = np.uint64
#: A word is a run of other characters than these (space and the control characters 9 to 13).
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: Most rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def as_text(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded for texts: rows of up to 64 MB would wait in the
    JVM and again in Python. Smaller settings stay. The setting counts when a plan runs, so it is left on.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def fold(column: str, parts: int) -> Column:
    """crc32 of a column's text modulo ``parts``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def unit_draw(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only (52 bits of an md5)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``limit`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the row bounds; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word, and per row the range of its words."""
    blank = _BLANK[data]
    before, after = np.empty_like(blank), np.empty_like(blank)
    if len(data):
        before[0], after[-1] = True, True
        before[1:], after[:-1] = blank[:-1], blank[1:]
        edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
        before[edges], after[edges - 1] = True, True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, U64(base))
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: prefix sums of a polynomial, then scrambled with the length."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed numbers, as Spark keeps them."""
    return x.view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column of consecutive ranges of ``values``."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """All columns as one struct ``row`` and the named ones beside it, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{n}`") for n in names])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def sent_if_small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """``df`` (narrow and already written) marked for broadcast when it has at most ``rows`` rows; else as it is,
    and Spark joins by key."""
    return F.broadcast(df) if df.count() <= rows else df


class HashIndex:
    """Open addressing from 64-bit hashes to numbers, looked up and filled array-wise."""

    def __init__(self, capacity: int = 1 << 16):
        self.keys, self.values, self.size = np.zeros(capacity, U64), np.zeros(capacity, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask = U64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        at = (hashes & mask).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            slot = at[open_]
            seen = self.keys[slot]
            hit = seen == hashes[open_]
            out[open_[hit]] = self.values[slot[hit]]
            open_ = open_[~hit & (seen != 0)]
            at[open_] = (at[open_] + 1) & int(mask)
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Hashes must be new and distinct; hash 0 is never stored."""
        if 2 * (self.size + len(hashes)) > len(self.keys):
            old, kept = self.keys != 0, (self.keys, self.values)
            n = len(self.keys)
            while 2 * (self.size + len(hashes)) > n:
                n *= 2
            self.keys, self.values = np.zeros(n, U64), np.zeros(n, np.int64)
            self._put(kept[0][old], kept[1][old])
        self._put(hashes, values)
        self.size += len(hashes)

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (hashes & U64(mask)).astype(np.int64)
        open_ = np.flatnonzero(hashes != 0)
        while len(open_):
            slot = at[open_]
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[open_[free]]
            mine = free & (self.keys[slot] == hashes[open_])
            self.values[slot[mine]] = values[open_[mine]]
            open_ = open_[~mine]
            at[open_] = (at[open_] + 1) & mask


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
