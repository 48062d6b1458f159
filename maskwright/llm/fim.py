"""Fill-in-the-middle: a text is cut twice at unit bounds and its middle moved behind the rest.

Cuts are found as bytes. A sparse index of the characters of several bytes (their places and how many
bytes each has above one) turns byte offsets into code points and back; between its entries both run in
step, so pure ASCII stretches cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import as_text, in_small_batches, text_bytes, text_slices, word_bounds

#: Marks of prefix, suffix and middle, and the draws' percentages (fixed values of the contract).
MARKS = ("<P>", "<S>", "<M>")
SEED, MOVED_PERCENT, SPM_PERCENT = 42, 50, 80


@dataclass(frozen=True)
class Exceptions:
    """Where characters of several bytes start, and the bytes above one of all up to each."""

    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        return cls(at, np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64))

    def points(self, offsets: np.ndarray) -> np.ndarray:
        """Code points before each byte offset (an offset where a character starts, or the end)."""
        before = np.searchsorted(self.at, offsets)
        return offsets - np.append(0, self.excess)[before]

    def offsets(self, points: np.ndarray) -> np.ndarray:
        """Byte offset of each code point."""
        starts = self.at - np.append(0, self.excess)[:-1]
        return points + np.append(0, self.excess)[np.searchsorted(starts, points)]


class Units:
    """Units of texts that stand end to end: words with the blanks before them (blanks at the end of a text
    are a unit of their own), or single characters."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, index: Exceptions, unit: str = "word"):
        self.bounds, self.index, self.unit = bounds, index, unit
        if unit == "char":
            points = index.points(bounds)
            self.first, self.count = points[:-1], np.diff(points)
            return
        _, ends, own = word_bounds(data, bounds)
        self.ends = np.append(ends, len(data))
        words = np.diff(own)
        last = np.where(words > 0, self.ends[own[1:] - 1], bounds[:-1])
        self.first, self.count = own[:-1], words + (last < bounds[1:])

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Byte offset after the first ``k`` units of every text."""
        if self.unit == "char":
            return self.index.offsets(self.first + k)
        inside = self.ends[np.minimum(self.first + k - 1, len(self.ends) - 1)]
        return np.where(k == 0, self.bounds[:-1], np.where(k == self.count, self.bounds[1:], inside))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, moved: int = MOVED_PERCENT,
              spm: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS, unit: str = "word") -> DataFrame:
    """Add ``__units, __form, __prefix_chars, __middle_chars, __output`` to every row of ``docs``.

    The four draws are the first 32-bit groups of the sha256 of ``seed:key``. The prefix ends after the smaller and
    the middle after the larger of two drawn numbers of units. A text stays as it is (form ``plain``, lengths
    null) when it is empty or null, holds a mark, or its draw says so (``moved`` percent are rearranged); of the
    others ``spm`` percent are suffix first. Rows that repeat the key repeat its draws; a null key draws
    as an empty one. ``unit`` is ``word`` or ``char``. Columns whose names begin with the two
    underscores of the results must not be among those of ``docs``.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__draw{k}") for k in range(4)]
    source = in_small_batches(docs).select(*[F.col(f"`{c}`") for c in docs.columns], as_text(f"`{text}`").alias("__input"), *draws)
    kept = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{fields}, __units bigint, __form string, __prefix_chars bigint, __middle_chars bigint, __output string"
    signs = [m.encode() for m in marks]
    p, s, m = signs

    def rearranged(part: pa.RecordBatch) -> list[pa.Array]:
        data, bounds = text_bytes(part.column("__input"))
        index = Exceptions.of(data)
        units = Units(data, bounds, index, unit)
        h = np.stack([part.column(f"__draw{k}").to_numpy() for k in range(4)])
        a, b = np.sort(h[:2] % (units.count + 1), axis=0)
        raw = data.tobytes()
        low, high = bounds[:-1], bounds[1:]
        plain = (low == high) | (h[2] % 100 >= moved)
        for i in np.flatnonzero(~plain):
            plain[i] = any(raw.find(x, low[i], high[i]) >= 0 for x in signs)
        cuts = [units.cut(k) for k in (a, b)]
        points = [index.points(x) for x in (low, *cuts)]
        suffix_first = h[3] % 100 < spm
        out, form = [], []
        for i in range(part.num_rows):
            x, y = cuts[0][i], cuts[1][i]
            pre, mid, suf = raw[low[i] : x], raw[x:y], raw[y : high[i]]
            if plain[i]:
                form.append("plain")
                out.append(raw[low[i] : high[i]])
            elif suffix_first[i]:
                form.append("spm")
                out.append(b"".join((s, suf, p, pre, m, mid)))
            else:
                form.append("psm")
                out.append(b"".join((p, pre, s, suf, m, mid)))
        lengths = [pa.array(points[k + 1] - points[k], pa.int64(), mask=plain) for k in range(2)]
        return [pa.array(units.count, pa.int64()), pa.array(form, pa.string()), *lengths, pa.array(out, pa.binary()).cast(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*kept, "__units", "__form", "__prefix_chars", "__middle_chars", "__output"]
        for batch in batches:
            for part in text_slices(batch, "__input"):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *rearranged(part)], names=names)

    return source.mapInArrow(run, schema)


def restore(df: DataFrame, output: str = "__output", form: str = "__form", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add ``__restored``: the text that ``output`` and ``form`` stand for. SQL functions only.

    No text that was rearranged holds a mark, and no mark overlaps itself or another, so the marks split it in one way.
    """
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in marks), -1)
    second, third, fourth = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    whole = F.when(F.col(form) == "psm", F.concat(second, fourth, third)).when(F.col(form) == "spm", F.concat(third, fourth, second))
    return df.withColumn("__restored", F.coalesce(whole, F.col(output)))
