"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import U64, in_small_batches, lower_ascii, mix, span_hashes, text_bytes, text_slices, unit_draw, word_bounds
from maskwright.operators.numbering import number_rows
from maskwright.session import cut

BUCKETS = 1 << 16
#: Weight of the mean log ratio per n-gram, and the share of documents that is drawn.
SHARPNESS, SHARE = 20.0, 0.8
SEED = 77


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair of each text, and the text it belongs to."""
    data = lower_ascii(data)
    starts, ends, own = word_bounds(data, bounds)
    h = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(own))
    pair = doc[1:] == doc[:-1]
    two = mix(h[:-1] * U64(3) + h[1:])[pair] if len(h) > 1 else h[:0]
    both = np.concatenate([h, two])
    return (both >> U64(48)).astype(np.int64), np.concatenate([doc, doc[1:][pair] if len(h) > 1 else doc[:0]])


@dataclass(frozen=True)
class Ratio:
    """Log of target over raw probability of every bucket."""

    log: np.ndarray


def _counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                total += np.bincount(gram_buckets(*text_bytes(part.column("text")))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(target: DataFrame, raw: DataFrame, text: str = "text") -> Ratio:
    """Bucket models of all texts of ``target`` and of ``raw``, add-one smoothed. Null texts count as empty."""
    logs = []
    for texts in (in_small_batches(target), raw):
        n = np.ones(BUCKETS)
        for bucket, count in _counts(texts.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))).collect():
            n[bucket] += count  # BUCKETS rows at most
        logs.append(np.log(n / n.sum()))
    return Ratio(logs[0] - logs[1])


def weigh(docs: DataFrame, ratio: Ratio, text: str = "text") -> DataFrame:
    """Add ``__log_weight``: the mean log ratio over the n-grams of the text, 0 for texts without words."""
    names = docs.columns
    source = in_small_batches(docs).withColumn("__input", F.col(f"`{text}`").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__input"):
                bucket, doc = gram_buckets(*text_bytes(part.column("__input")))
                n = np.bincount(doc, minlength=part.num_rows)
                value = np.bincount(doc, ratio.log[bucket], part.num_rows) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(value)], names=[*names, "__log_weight"])

    return source.mapInArrow(run, f"{schema}, __log_weight double")


def resample(docs: DataFrame, ratio: Ratio, key: str = "doc_id", text: str = "text", share: float = SHARE, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """``key, log_weight, gumbel_key, selected``: a draw of round(share * n) rows without replacement.

    A row's chance follows exp(sharpness * log_weight): its key is that exponent plus Gumbel noise of a hash
    of seed, id and text, and the largest keys are selected. Ties, such as rows that repeat id and text,
    are broken by position. Places are counted over range partitions, so no task sees all rows.
    """
    noise = -F.log(-F.log((unit_draw(seed, key, "__t") + F.lit(2.0**-54))))
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__t"))
    rows = weigh(rows, ratio, "__t")
    rows = cut(rows.select(key, F.col("__log_weight").alias("log_weight"), (F.lit(sharpness) * F.col("__log_weight") + noise).alias("gumbel_key")))
    k = round(share * rows.count())
    placed = number_rows(rows, [], [F.desc("gumbel_key"), F.col(key)], "place")
    return placed.select(key, "log_weight", "gumbel_key", (F.col("place") <= k).alias("selected"))
