"""Packing documents into fixed-length sequences by bounded-space online best fit."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import U64, HashIndex, in_small_batches, ranges, span_hashes, text_bytes, text_slices

LENGTH = 1024
END_ID = 2
OPEN_BINS = 256
CACHED_STRETCHES = 1 << 21


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class StretchTokenizer:
    """Token ids of whole texts; every distinct stretch of text is tokenized once per task.

    Texts are cut before a space and around a line break that stand alone between two characters that
    are no white space, and before a mark that follows a letter. The tokenizer's own pattern always
    starts a new run there, so the ids of the stretches one after the other are those of the text. Stretches are recognised by a 64-bit hash. The memory
    holds ``CACHED_STRETCHES`` stretches and starts anew when full.
    """

    _white = np.zeros(256, bool)
    _white[[*range(9, 14), *range(28, 33)]] = True
    _mark = np.zeros(256, bool)
    _mark[list(b".,;:!?")] = True
    _letter = np.zeros(256, bool)
    _letter[[*range(65, 91), *range(97, 123)]] = True

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex()
        self.pool, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """First byte of every stretch."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        at = at[(at >= 3) & (at + 1 < n)]
        one, two, three, after = data[at - 1], data[at - 2], data[at - 3], data[at + 1]
        wide = ((three >= 0xE1) & (three <= 0xE3) & (one >= 0x80)) | (two == 0xC2)  # may be white space beyond ASCII
        wide |= (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
        at = at[~(self._white[one] | self._white[after] | wide)]
        last = np.zeros(n + 1, bool)
        last[bounds[1:]] = True
        at = at[~last[at + 1]]
        cut[at] = True
        cut[at[data[at] == 0x0A] + 1] = True
        mark = np.flatnonzero(self._mark[data])
        mark = mark[mark >= 2]
        one, two = data[mark - 1], data[mark - 2]
        cut[mark[self._letter[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]] = True
        cut[bounds[:-1]] = True
        return np.flatnonzero(cut[:n])

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), self.pool.dtype, int(sizes.sum()))
        n, m = self.index.size, self.used
        while m + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(ids) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[m : m + len(flat)] = flat
        self.starts[n : n + len(ids)] = m + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(ids)] = sizes
        self.used += len(flat)
        self.index.add(hashes, n + np.arange(len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text; null counts as empty."""
        data, bounds = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts = self._starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes = np.maximum(span_hashes(data, starts, ends), U64(1))
        if self.index.size > CACHED_STRETCHES:
            self.clear()
        found = self.index.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            self._learn(data, starts[new[first]], ends[new[first]], distinct)
            found[new] = self.index.find(hashes[new])
        sizes = self.sizes[found]
        ids = self.pool[ranges(self.starts[found], sizes)].astype(np.uint32)
        return ids, np.append(0, np.cumsum(sizes))[np.searchsorted(starts, bounds)]


class BestFit:
    """At most ``limit`` open bins; bit f of ``levels`` is set while some open bin has f places left."""

    def __init__(self, length: int, limit: int, first_id: int):
        self.length, self.limit, self.next_id = length, limit, first_id
        self.levels, self.open, self.count = 0, [[] for _ in range(length + 1)], 0

    def _take(self, free: int) -> int:
        bin_id = self.open[free].pop()
        if not self.open[free]:
            self.levels &= ~(1 << free)
        self.count -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the open bin it fills best, else a new one."""
        fitting = self.levels >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count == self.limit and size < self.length:
                self._take((self.levels & -self.levels).bit_length() - 1)  # the fullest closes
            free, bin_id = self.length, self.next_id
            self.next_id += 1
        left = free - size
        if left:
            self.open[left].append(bin_id)
            self.levels |= 1 << left
            self.count += 1
        return bin_id, self.length - free


SCHEMA = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", length: int = LENGTH,
         open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document and its place in a sequence of ``length`` tokens.

    A document is the ids of its text and ``end_id``; null and empty texts are ``end_id`` alone. Only
    documents over ``length`` are cut: whole sequences from their end, so that the first piece is the
    remainder. Each task packs the documents of its partition as they come, with ``open_bins`` bins
    open; sequence numbers are unique over all tasks. Rows that repeat a document are packed each.
    ``with_ids`` adds the ids themselves. Other columns of ``docs`` are not carried along.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()
    source = in_small_batches(docs).select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = StretchTokenizer(path)  # its memory ends with the task
        bins = BestFit(length, open_bins, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in text_slices(batch, "__text"):
                ids, bounds = coder.encode(part.column("__text"))
                rows, out, chunks = [], [], []
                for k in range(part.num_rows):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    cuts = [*range(len(own) % length or length, len(own), length), len(own)] if len(own) > length else [len(own)]
                    at = 0
                    for piece, end in enumerate(cuts):
                        bin_id, offset = bins.place(end - at)
                        rows.append(k)
                        out.append((piece, at, end - at, zlib.crc32(own[at:end].tobytes()), bin_id, offset))
                        if with_ids:
                            chunks.append(own[at:end])
                        at = end
                columns = [pa.array(c, pa.int32() if n == 0 else pa.int64()) for n, c in enumerate(zip(*out, strict=True))]
                arrays = [part.column("__key").take(pa.array(rows)), *columns]
                names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(chunks, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}" + ", ids array<bigint>" * with_ids)
