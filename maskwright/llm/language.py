"""Language identification by the nearest of several centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import in_small_batches, lower_ascii, text_bytes, text_slices, unit_draw

SLOTS = 8192
CENTROIDS = 4
#: Labelled texts per language (expected number) that the centroids are fitted on.
SAMPLE = 1000
MAX_LANGUAGES = 1000
#: A text is rejected when its cosine is below this share of a low quantile of its language's, which is taken over
#: one in ``APART`` of the drawn texts, which no centroid is fitted on.
SLACK, LOW, APART = 0.5, 0.01, 4
#: A text with k distinct n-grams reaches a cosine of about sqrt(k); from this k on, no more is expected.
FULL_GRAMS = 200
GROUP = 128
UNKNOWN = "und"


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTERS = _letters()


def gram_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of hashed byte n-grams (1 to 3) of each text, marks and digits read as blanks."""
    n = len(bounds) - 1
    data = lower_ascii(data)
    data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32  # capitals with marks
    data = _LETTERS[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds)) * SLOTS
    out = np.zeros(n * SLOTS, np.int64)
    code = np.zeros(len(data), np.uint32)
    inside = np.ones(len(data), bool)
    for k in range(3):
        size = len(data) - k
        if size <= 0:
            break
        code = code[:size] * np.uint32(257) + data[k:]
        inside = inside[:size]
        if k:
            ends = bounds[1:] - k
            inside[ends[(ends >= 0) & (ends < size)]] = False
        slot = (((code + np.uint32(k * 77)) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
        blank = data[:size] == 32
        for j in range(1, k + 1):
            blank = blank & (data[j : size + j] == 32)
        take = inside & ~blank
        out += np.bincount((doc[:size] + slot)[take], minlength=n * SLOTS)
    return out.reshape(n, SLOTS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + log tf) * idf, scaled to length one; texts without n-grams stay zero."""
    x = np.zeros(counts.shape, np.float32)
    some = counts > 0
    x[some] = 1 + np.log(counts[some].astype(np.float32))
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def reach(counts: np.ndarray) -> np.ndarray:
    """Share of the full cosine that a text of this many distinct n-grams can be expected to have."""
    return np.sqrt(np.clip((counts > 0).sum(axis=1) / FULL_GRAMS, 1e-6, 1.0))


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in text_slices(batch, column):
        for at in range(0, part.num_rows, GROUP):
            some = part.slice(at, GROUP)
            yield some, gram_counts(*text_bytes(some.column(column)))


@dataclass(frozen=True)
class Centroids:
    """Fitted model: rows of ``matrix`` belong to ``langs`` and reject below ``floors``."""

    idf: np.ndarray
    langs: list[str]
    matrix: np.ndarray
    floors: np.ndarray


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all texts each slot occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for part, counts in _groups(batch, "__text"):
                total[:SLOTS] += (counts > 0).sum(axis=0)
                n += part.num_rows
        total[SLOTS] = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    parts = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, "slot bigint, n bigint")
    out = np.zeros(SLOTS + 1, np.int64)
    for slot, n in parts.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS + 1 rows at most
        out[slot] = n
    return out[:SLOTS], int(out[SLOTS])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means from spread-out seeds."""
    seeds = [x.mean(axis=0)]
    nearest = np.full(len(x), -1.0)
    for _ in range(min(k, len(x)) - 1):
        nearest = np.maximum(nearest, x @ (seeds[-1] / max(np.linalg.norm(seeds[-1]), 1e-12)))
        seeds.append(x[int(np.argmin(nearest))])
    c = np.stack(seeds)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]


def low_cosine(x: np.ndarray, reached: np.ndarray, c: np.ndarray) -> float:
    """Low quantile of the texts' best cosines for their reach; a few mislabelled texts do not move it."""
    return float(np.quantile((x @ c.T).max(axis=1) / reached, LOW))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", k: int = CENTROIDS, sample: int = SAMPLE, slack: float = SLACK) -> Centroids:
    """Fit on rows with text and language. The idf covers all of them; the centroids of a language
    are clustered on about ``sample`` of its different texts (all, when there are no more), drawn by a hash.
    Rows without letters teach nothing.
    """
    rows = in_small_batches(labelled).select(F.col(f"`{text}`").cast("string").alias("__text"), F.col(f"`{lang}`").cast("string").alias("__lang"))
    rows = rows.where(F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}"))
    texts = rows.select("__lang", F.xxhash64("__text").alias("h")).distinct()
    sizes = texts.groupBy("__lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Centroids(np.ones(SLOTS, np.float32), [], np.zeros((0, SLOTS), np.float32), np.zeros(0))
    df, n = document_frequencies(rows, "__text")
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    rate = F.create_map(*[F.lit(x) for name, size in sizes for x in (name, min(1.0, sample / size))])
    # The draw is by text, so copies are drawn together; distinct() leaves one of them.
    drawn = rows.where(unit_draw(11, "__text", "__lang") < rate[F.col("__lang")]).distinct()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pa.RecordBatch.from_arrays([pa.array(sorted(pdf["__text"]), pa.string())], names=["t"])
        parts = [(vectors(c, idf), reach(c)) for _, c in _groups(texts, "t")]
        x, reached = np.concatenate([x for x, _ in parts]), np.concatenate([r for _, r in parts])
        apart = np.arange(len(x)) % APART == APART - 1
        if not apart.any():
            apart[:] = True
        c = cluster(x[~apart] if (~apart).any() else x, k)
        low = low_cosine(x[apart], reached[apart], c)
        return pd.DataFrame({"lang": [pdf["__lang"].iloc[0]] * len(c), "part": range(len(c)), "low": [low] * len(c), "c": list(c.astype(np.float32))})

    fitted = drawn.groupBy("__lang").applyInPandas(group, "lang string, part int, low double, c array<float>").collect()
    fitted.sort(key=lambda r: (r.lang, r.part))  # languages times k rows
    missing = {name for name, _ in sizes} - {r.lang for r in fitted}
    if missing:
        raise RuntimeError(f"no text drawn for languages {sorted(missing)}")
    matrix = np.array([r.c for r in fitted], np.float32).reshape(len(fitted), SLOTS)
    return Centroids(idf, [r.lang for r in fitted], matrix, np.array([slack * r.low for r in fitted]))


def predict(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Add ``__lang, __score, __rejected`` to every row, from its text alone.

    ``__lang`` is the language of the nearest centroid and ``__score`` its cosine (0 to 1). Texts that
    are null or have no letter are ``und`` with score 0 and rejected; others are rejected when their
    cosine is below the centroid's floor. Ties go to the language first in code point order.
    Without any learned language all rows are ``und``.
    """
    letters = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    source = in_small_batches(docs).withColumns({"__input": F.col(f"`{text}`").cast("string"), "__letters": letters})
    names_in = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part, counts in _groups(batch, "__input"):
                known = np.asarray(part.column("__letters").to_numpy(zero_copy_only=False), bool) & bool(model.langs)
                best, score = np.full(part.num_rows, len(model.langs)), np.zeros(part.num_rows)
                rejected = ~known
                if known.any():
                    sims = vectors(counts[known], model.idf) @ model.matrix.T
                    best[known] = sims.argmax(axis=1)
                    score[known] = np.clip(sims.max(axis=1), 0.0, 1.0)
                    rejected[known] = sims.max(axis=1) < model.floors[best[known]] * reach(counts[known])
                columns = [part.column(c) for c in names_in]
                more = [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns + more, names=[*names_in, "__lang", "__score", "__rejected"])

    return source.mapInArrow(run, f"{schema}, __lang string, __score double, __rejected boolean")
