"""Toxicity by non-negative positive-unlabelled learning: linear numpy classifiers over words and word beginnings.

Confirmed toxic texts are the positives; all other training texts, whatever their label, are unlabelled.
With the class prior p the risk of a score z is p * R_pos(z) + max(0, R_unl(-z) - p * R_pos(-z)): the
unlabelled texts taken as negative, corrected for the positives among them, and never below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import U64, HashIndex, in_small_batches, lower_ascii, signed, span_hashes, text_bytes, text_slices, unit_draw

#: Bounds of the training sample (expected numbers of texts) and of its features.
POSITIVES, UNLABELLED = 4000, 16_000
CANDIDATES, FEATURES = 50_000, 2048
LEAST_TEXTS = 5
TELLING = 0.3
#: Lengths of word beginnings, in bytes.
BEGINNINGS = (4, 5, 6, 7, 8)
MEMBERS = 3

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def text_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and word beginning, and the text each belongs to. Words are runs of letters."""
    data = lower_ascii(data)
    if len(data):
        data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32  # capitals with marks
    mark = np.zeros(len(data) + 2, np.int8)
    mark[1:-1] = _LETTER[data]
    edge = np.diff(mark)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = bounds[1:-1]
    split = inner[(inner > 0) & (inner < len(data))]
    split = np.unique(split[_LETTER[data[split]] & _LETTER[data[split - 1]]]) if len(split) else split
    starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    doc = np.searchsorted(bounds, starts, side="right") - 1
    hashes, docs = [span_hashes(data, starts, ends)], [doc]
    for n in BEGINNINGS:
        long = ends - starts > n
        hashes.append(span_hashes(data, starts[long], starts[long] + n) ^ U64(n))
        docs.append(doc[long])
    return np.maximum(np.concatenate(hashes), U64(1)), np.concatenate(docs)


@dataclass(frozen=True)
class Model:
    """Features by hash, their weights (one column per classifier), and the biases."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def index(self) -> HashIndex:
        found = HashIndex()
        found.add(self.hashes, np.arange(len(self.hashes)))
        return found


def present(index: HashIndex, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every known feature that a text holds, once each, in order of the texts."""
    hashes, docs = text_features(data, bounds)
    found = index.find(hashes)
    both = np.unique(docs[found >= 0] << 32 | found[found >= 0])
    return both >> 32, both & 0xFFFFFFFF


def nn_pu(x: np.ndarray, positive: np.ndarray, prior: float, seed: int, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimises the non-negative risk of logistic losses.

    Each member starts from its own draw and leaves out a tenth of the texts. When the part that stands
    for the negatives falls below zero, the step goes against it instead of with it.
    """
    rng = np.random.default_rng(seed)
    keep = rng.random(len(x)) < 0.9
    p, u = x[keep & positive], x[keep & ~positive]
    w, b = rng.normal(0, 0.01, x.shape[1]).astype(np.float32), np.float32(-1.0)
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        gp, gu = -prior * sp / len(p), su / len(u)
        if negative >= 0:
            gp = gp + prior * (sp - 1) / len(p)
        else:
            gp, gu = -gp, -gu
        grad = np.append(p.T @ gp + u.T @ gu + decay * w * (negative >= 0), gp.sum() + gu.sum())
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = rate * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return w, float(b)


def _train(pdf: pd.DataFrame, prior: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen features, their weights and the biases, from the texts' feature numbers."""
    pdf = pdf.sort_values(["positive", "draw"])
    positive = pdf["positive"].to_numpy(bool)
    if positive.all() or not positive.any():
        return np.zeros(0, np.int64), np.zeros((0, MEMBERS)), np.full(MEMBERS, np.log(prior / (1 - prior)))
    rows = np.repeat(np.arange(len(pdf)), pdf["found"].map(len))
    cols = np.concatenate([*pdf["found"], np.zeros(0)]).astype(np.int64)
    in_p = np.bincount(cols[positive[rows]], minlength=n) / max(positive.sum(), 1)
    in_u = np.bincount(cols[~positive[rows]], minlength=n) / max((~positive).sum(), 1)
    gain = in_p * np.log((in_p + 1e-4) / (in_u + 1e-4))
    gain[prior * in_p < TELLING * in_u] = 0  # by the prior, too few of the texts that hold it are toxic
    chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(n, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(pdf), len(chosen)), np.float32)
    some = place[cols] >= 0
    x[rows[some], place[cols[some]]] = 1
    fitted = [nn_pu(x, positive, prior, seed) for seed in range(MEMBERS)]
    return chosen, np.stack([w for w, _ in fitted], axis=1), np.array([b for _, b in fitted])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Train on ``docs`` and the rows of ``labels`` given (leave held-out rows out of both).

    The prior is the share of toxic ones among all labelled rows. The sample is drawn by hashes: about
    ``POSITIVES`` toxic texts, about ``UNLABELLED`` of all texts; equal texts count once. Candidate
    features stand in at least ``LEAST_TEXTS`` different positives. Null when no row is labelled toxic. When no
    toxic row has a text, or there are no texts at all, the model has no features and gives every text the prior.
    """
    labels = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    n_pos, n_all = labels.agg(F.count_if(F.col("y") == 1), F.count(F.lit(1))).first()
    if not n_pos:
        return None
    prior = min(max(n_pos / n_all, 1e-4), 0.9)
    toxic = labels.where("y = 1").select("id").distinct().where(unit_draw(23, "id") < POSITIVES / n_pos)
    rows = in_small_batches(docs).select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    n_docs = rows.count()
    drawn = unit_draw(29, "id", "text")
    # About POSITIVES ids, a documented bound: every task can hold them, and no text is shuffled for the join.
    p = rows.join(F.broadcast(toxic), "id", "left_semi").select("text", F.lit(True).alias("positive"), drawn.alias("draw"))
    u = rows.where(drawn < UNLABELLED / max(n_docs, 1)).select("text", F.lit(False).alias("positive"), drawn.alias("draw"))
    sample = p.union(u).groupBy("text", "positive").agg(F.min("draw").alias("draw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                hashes, of = text_features(*text_bytes(part.column("text")))
                order = np.lexsort((of, hashes))
                hashes, of = hashes[order], of[order]
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
                values, n = np.unique(hashes[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n, pa.int64())], names=["h", "n"])

    counted = p.groupBy("text").agg(F.min("draw").alias("draw")).select("text").mapInArrow(count, "h bigint, n bigint")
    often = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    hashes = np.array([r.h for r in often.orderBy(F.desc("n"), "h").limit(CANDIDATES).collect()], np.int64).view(U64)
    candidates = Model(hashes, np.zeros((len(hashes), 0)), np.zeros(0))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = candidates.index()
        for batch in batches:
            for part in text_slices(batch, "text"):
                of, found = present(index, *text_bytes(part.column("text")))
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found, pa.int32()))
                columns = [pa.array(np.zeros(part.num_rows, np.int32)), part.column("positive"), part.column("draw"), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "positive", "draw", "found"])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, weights, bias = _train(pdf, prior, len(hashes))
        return pd.DataFrame({"feature": [*chosen.tolist(), -1], "w": [*weights.astype(float).tolist(), bias.tolist()]})

    texts = sample.mapInArrow(sparse, "part int, positive boolean, draw double, found array<int>")
    fitted = texts.groupBy("part").applyInPandas(train, "feature int, w array<double>").collect()  # FEATURES + 1 rows
    if not fitted:
        return Model(hashes[:0], np.zeros((0, MEMBERS)), np.full(MEMBERS, np.log(prior / (1 - prior))))
    fitted.sort(key=lambda r: r.feature)
    order = [r.feature for r in fitted[1:]]
    return Model(hashes[order], np.array([r.w for r in fitted[1:]]).reshape(len(order), MEMBERS), np.array(fitted[0].w))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``__score`` (0 to 1) from the text alone: the mean of the classifiers' probabilities.

    Null and empty texts hold no feature and get the score of that. Without a model all are 0.
    """
    if model is None:
        return docs.withColumn("__score", F.lit(0.0))
    names = docs.columns
    source = in_small_batches(docs).withColumn("__input", F.col(f"`{text}`").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index()
        for batch in batches:
            for part in text_slices(batch, "__input"):
                of, found = present(index, *text_bytes(part.column("__input")))
                z = np.stack([np.bincount(of, w[found], part.num_rows) for w in model.weights.T], axis=1) + model.bias
                value = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(value)], names=[*names, "__score"])

    return source.mapInArrow(run, f"{schema}, __score double")
