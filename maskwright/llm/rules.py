"""Quality rules: plain counts, and the log-likelihood ratio of two hashed n-gram multinomials, trusted against raw text.

The ratio of a text is the mean over its character n-grams, so length does not count, and a text is kept
when it reaches one threshold: a low quantile of trusted texts that the multinomials were not counted on,
less a margin. No draw is involved. Logs are whole numbers (millionths), so sums agree on any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import U64, as_text, in_small_batches, mix, sent_if_small, span_hashes, text_bytes, text_slices, unit_draw, word_bounds
from maskwright.operators.quantiles import exact_quantiles
from maskwright.session import cut

GRAM, BUCKETS = 3, 1 << 16
_STEP, _PRIME = 1_000_003, 2_147_483_647
#: This share of the trusted texts (drawn by a hash of the key) sets the threshold, the others are counted.
SETTING, SEED = 0.25, 53
#: Quantile of the trusted texts' ratios, and what is taken off it (millionths of a nat per n-gram).
QUANTILE, MARGIN = 0.005, 250_000
#: The base rule (fixed values of the contract): fewest words, words of a window, percent of words in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
POINTS_AT_ONCE = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of code points inside a text, and the text of each, in stretches of bounded size."""
    starts = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    texts = starts[bounds]  # bounds of the texts in code points
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), POINTS_AT_ONCE):
        some = points[at : at + POINTS_AT_ONCE + GRAM - 1].astype(U64)
        n = len(some) - GRAM + 1
        if n <= 0:
            break
        code = some[:n]
        for k in range(1, GRAM):
            code = code * U64(_STEP) + some[k : n + k]
        place = np.arange(at, at + n)
        text = np.searchsorted(texts, place, side="right") - 1
        inside = place + GRAM <= texts[text + 1]
        yield (code[inside] % U64(_PRIME) % U64(BUCKETS)).astype(np.int64), text[inside]


def base_counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: words, code points in words, symbols, repeated lines, and words in repeated windows."""
    n = len(bounds) - 1
    starts, ends, own = word_bounds(data, bounds)
    doc = np.repeat(np.arange(n), np.diff(own))

    def over_bytes(mark: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mark))
        return sums[high] - sums[low]

    chars = np.bincount(doc, over_bytes((data & 0xC0) != 0x80, starts, ends), n).astype(np.int64)
    symbols = over_bytes(_SYMBOL[data], bounds[:-1], bounds[1:])
    # Lines: bounds of texts and what follows a line break. A line break at the end of a text opens an empty line, which has no word.
    breaks = np.flatnonzero(data == 10)
    low = np.union1d(bounds[:-1], breaks + 1)
    low = low[low < len(data)] if len(data) else low[:0]
    high = np.append(low[1:], len(data))
    line_doc = np.searchsorted(bounds, low, side="right") - 1
    high = high - (data[high - 1] == 10) if len(high) else high
    worded = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    low, high, line_doc = low[worded], high[worded], line_doc[worded]
    line = mix(span_hashes(data, low, high) ^ mix(line_doc.astype(U64) + U64(1)))
    lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[np.unique(line, return_index=True)[1]], minlength=n)
    # Windows: a hash of the words' hashes and their text; what occurs twice marks its words.
    repeated = np.zeros(len(doc) + 1, np.int64)
    m = len(doc) - WINDOW + 1
    if m > 0:
        word = span_hashes(data, starts, ends)
        window = mix(doc[:m].astype(U64) + U64(1))
        for k in range(WINDOW):
            window = mix(window * U64(3) + word[k : m + k])
        inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        _, of, times = np.unique(window[inside], return_inverse=True, return_counts=True)
        twice = inside[times[of] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    covered = np.bincount(doc, np.cumsum(repeated)[:-1] > 0, n).astype(np.int64)
    return np.diff(own), chars, symbols, lines.astype(np.int64), covered


@dataclass(frozen=True)
class Ratio:
    """Log ratio of every bucket in millionths, and the least mean that is kept."""

    log: np.ndarray
    threshold: float


def _gather(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of trusted texts (part not 0) and of all texts, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                counted = part.column("counted").to_numpy(zero_copy_only=False)
                for bucket, doc in gram_buckets(*text_bytes(part.column("text"))):
                    total[1] += np.bincount(bucket, minlength=BUCKETS)
                    total[0] += np.bincount(bucket[counted[doc]], minlength=BUCKETS)
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(t[used]) for t in total]], names=["bucket", "trusted", "raw"])

    sums = rows.mapInArrow(run, "bucket int, trusted bigint, raw bigint").groupBy("bucket").agg(F.sum("trusted"), F.sum("raw"))
    trusted, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for bucket, t, r in sums.collect():  # BUCKETS rows at most
        trusted[bucket], raw[bucket] = t, r
    return trusted, raw


def log_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Add-one smoothed log ratio of every bucket, in millionths."""
    t, r = int(trusted.sum()) + BUCKETS, int(raw.sum()) + BUCKETS
    return np.array([round(1e6 * math.log(float((int(a) + 1) * r) / float((int(b) + 1) * t))) for a, b in zip(trusted, raw, strict=True)], np.int64)


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> Ratio:
    """Fit on all texts of ``docs`` (the raw corpus) and those whose ``key`` is in ``trusted``.

    Three quarters of the trusted texts (by a hash of the key) are the target; the others set the
    threshold. Without trusted texts all ratios are 0 and every text reaches the threshold; without any for the
    threshold every text does too. Null texts count as empty.
    """
    ids = cut(trusted.select(F.col(f"`{key}`").alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_trusted", F.lit(True)))
    rows = in_small_batches(docs).select(F.col(f"`{key}`").alias("_k"), as_text(f"`{text}`").alias("text"))
    rows = rows.join(sent_if_small(ids), "_k", "left")
    counted = F.coalesce(F.col("_trusted"), F.lit(False)) & (unit_draw(SEED, "_k") >= SETTING)
    target, raw = _gather(rows.select("text", counted.alias("counted")))
    if not target.any():
        return Ratio(np.zeros(BUCKETS, np.int64), -math.inf)
    log = log_ratios(target, raw)
    others = rows.where(F.col("_trusted") & (unit_draw(SEED, "_k") < SETTING) & (F.length("text") >= GRAM)).select("text")
    low = exact_quantiles(weigh(others, log).select("__score"), [], "__score", {"low": QUANTILE}).first()
    return Ratio(log, -math.inf if low is None or low.low is None else low.low - MARGIN)


def weigh(rows: DataFrame, log: np.ndarray) -> DataFrame:
    """``rows`` with ``__score`` from ``text`` (no null): the mean ratio of its n-grams, 0 when it has none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mean_ratios(*text_bytes(part.column("text")), log))], names=[*names, "__score"])

    return rows.mapInArrow(run, f"{fields}, __score double")


def mean_ratios(data: np.ndarray, bounds: np.ndarray, log: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    total, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for bucket, doc in gram_buckets(data, bounds):
        # Sums of a stretch stay below 2^53, so the doubles of bincount are exact.
        total += np.bincount(doc, log[bucket], n).astype(np.int64)
        size += np.bincount(doc, minlength=n)
    return total / np.maximum(size, 1)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def judge(docs: DataFrame, ratio: Ratio, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, then the columns of ``RESULT`` with two underscores before the name.

    ``__score`` is the mean log ratio per n-gram in millionths of a nat. Null and empty texts have counts 0 and
    score 0 and fail the base rule. Repeated rows are judged each, by their text alone.
    """
    others = [c for c in docs.columns if c != text]
    source = in_small_batches(docs).select(*[F.col(f"`{c}`") for c in others], as_text(f"`{text}`").alias("__judged"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    kinds = ["bigint"] * 5 + ["boolean"] * 2 + ["double"]
    schema = fields + ", ".join(f"__{n} {k}" for n, k in zip(RESULT, kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__judged"):
                data, bounds = text_bytes(part.column("__judged"))
                counts = base_counts(data, bounds)
                score = mean_ratios(data, bounds, ratio.log)
                failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
                columns = [*[pa.array(c, pa.int64()) for c in counts], pa.array(failed), pa.array(~failed & (score >= ratio.threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *columns], names=[*others, *[f"__{n}" for n in RESULT]])

    return source.mapInArrow(run, schema)
