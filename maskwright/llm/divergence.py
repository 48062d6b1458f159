"""Audit of how the sources of each language differ in their terms.

Inside tasks Arrow functions lower, split and encode the texts and count terms per language and source. Spark
merges the partial counts. The kept terms of a language are then dealt to shards by hash; a shard is a
table of all its sources by some of its terms, from which the differences are taken in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from maskwright.llm.common import as_text, in_small_batches, sent_if_small, text_bytes, text_slices
from maskwright.session import cut

#: What stands between terms: other ASCII characters than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a kept term is in, weight of the smoothing, whole of a share, ranks of the term part.
LEAST_DOCUMENTS, SMOOTH, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Partial counts held in a task before they are sent on, and cells (sources x terms) of a shard.
FLUSH_ROWS, SHARD_CELLS = 1 << 19, 1 << 16
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def slice_counts(part: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, docs`` of a slice: occurrences, and rows that hold the term; the empty term counts the rows."""
    # A slice that does not start at 0 is lowered wrongly, so its bytes are taken out first.
    data, bounds = text_bytes(part.column("text"))
    texts = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(bounds), pa.py_buffer(data))
    words = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.not_equal(pc.binary_length(term), 0)
    row, term = row.filter(some), term.filter(some).cast(pa.string())
    langs, sources = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
    terms = term.dictionary_encode()
    in_rows = pa.table({"row": row, "term": terms.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    in_rows = pa.table({
        "lang": langs.indices.take(in_rows.column("row")), "source": sources.indices.take(in_rows.column("row")),
        "term": in_rows.column("term"), "n": in_rows.column("count_all"),
    })
    counted = in_rows.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")])
    rows = pa.table({"lang": langs.indices, "source": sources.indices}).group_by(["lang", "source"]).aggregate([([], "count_all")])
    return pa.concat_tables([
        pa.table([langs.dictionary.take(counted.column("lang")), sources.dictionary.take(counted.column("source")), terms.dictionary.take(counted.column("term")),
                  counted.column("n_sum"), counted.column("count_all")], schema=COUNTS),
        pa.table([langs.dictionary.take(rows.column("lang")), sources.dictionary.take(rows.column("source")), pa.array([""] * len(rows), pa.string()),
                  pa.array(np.zeros(len(rows), np.int64)), rows.column("count_all")], schema=COUNTS),
    ])


def merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(COUNTS.names).cast(COUNTS)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the texts of a task, merged as long as they are few enough to hold."""
    waiting: list[pa.Table] = []
    held = settled = 0
    for batch in batches:
        for part in text_slices(batch, "text"):
            waiting.append(slice_counts(part))
            held += waiting[-1].num_rows
            if held > 2 * settled + (FLUSH_ROWS >> 3):
                waiting = [merged(waiting)]
                held = settled = waiting[0].num_rows
            if settled > FLUSH_ROWS:
                yield from waiting[0].to_batches()
                waiting, held, settled = [], 0, 0
    if waiting:
        yield from merged(waiting).to_batches()


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + SMOOTH) / (total + SMOOTH * kept)), three digits of WHOLE at a time so that
    no product leaves 64 bits (totals below 9e15)."""
    below = totals + SMOOTH * kept
    rest, out = counts + SMOOTH, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


RESULT = "lang string, source string, part string, item string, value bigint"


def shard_differences(table: pa.Table) -> pa.Table:
    """Differences of all pairs of sources over the terms of a shard, and the shard's ``RANKS`` best terms of each source.

    Rows without a term name the sources of the language, with their totals and the number of kept terms.
    """
    lang = table.column("lang")[0].as_py()
    heads = table.filter(pc.is_null(table.column("term"))).sort_by("source")
    body = table.filter(pc.is_valid(table.column("term")))
    names, totals, kept = heads.column("source").combine_chunks(), heads.column("n").to_numpy(), int(heads.column("kept")[0].as_py())
    terms = pc.unique(body.column("term")).sort() if body.num_rows else pa.array([], pa.string())
    counts = np.zeros((len(names), len(terms)), np.int64)
    at = [pc.index_in(body.column(c), value_set=v).to_numpy() for c, v in (("source", names), ("term", terms))]
    counts[at[0], at[1]] = body.column("n").to_numpy()
    out = {"source": [], "part": [], "item": [], "value": []}

    def add(source: int, part: str, items: pa.Array, values: np.ndarray) -> None:
        out["source"].append(pa.repeat(names[source], len(items)))
        out["part"].append(pa.repeat(part, len(items)))
        out["item"].append(items)
        out["value"].append(pa.array(values, pa.int64()))

    own = shares(counts, totals[:, None], kept) if len(terms) else counts
    whole = shares(counts.sum(axis=0), totals.sum(), kept) if len(terms) else counts[:0].sum(axis=0)
    for i in range(len(names)):
        others = np.flatnonzero(np.arange(len(names)) != i)
        add(i, "pair", names.take(pa.array(others)), np.abs(own[others] - own[i]).sum(axis=1))
        more = own[i] - whole
        good = np.flatnonzero((counts[i] > 0) & (more > 0))
        best = good[np.lexsort((good, -more[good]))[:RANKS]]  # the terms are sorted
        add(i, "term", terms.take(pa.array(best)), more[best])
    columns = {k: pa.chunked_array(v) if v else pa.chunked_array([], pa.string()) for k, v in out.items()}
    return pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(columns["source"])), **columns})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, part, item, value, rank`` as follows; nulls in all three columns read as ''.

    A term is a run of letters (all characters above ASCII count as such), A-Z lowered. A language keeps the terms that
    ``least`` of its rows hold; repeated rows count each. Per (language, source) and per language a kept term's
    share is ``shares`` of its occurrences. Part ``pair``: the summed absolute differences to every other source of the
    language (0 when no term is kept). Part ``term``: the 50 terms whose share is furthest above the language's.
    Equal values stand in order of the item's bytes. Sources of a single-source language have no pair rows; an
    empty table gives no row.
    """
    rows = in_small_batches(docs).select(as_text(f"`{text}`").alias("text"), as_text(f"`{lang}`").alias("lang"), as_text(f"`{source}`").alias("source"))
    partial = rows.mapInArrow(partial_counts, "lang string, source string, term string, n bigint, docs bigint")
    # One shuffle by language and term serves both the merge and the filter by documents.
    counts = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumn("in_lang", F.sum("docs").over(W.partitionBy("lang", "term")))
    counts = cut(counts.where((F.col("in_lang") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n"))
    terms = counts.where("term <> ''")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))  # the empty term adds 0
    kept = terms.groupBy("lang").agg(F.count_distinct("term").alias("kept"))
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept, "lang", "left").fillna(0, ["kept"])
    per_lang = per_lang.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / F.lit(SHARD_CELLS))).cast("int"))
    per_lang = sent_if_small(cut(per_lang))  # one row a language; a join by key would put a language's terms into one task
    heads = groups.join(per_lang, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    heads = heads.select("lang", "shard", "source", F.lit(None).cast("string").alias("term"), "n", "kept")
    dealt = terms.join(per_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n", "kept")
    found = dealt.unionByName(heads).groupBy("lang", "shard").applyInArrow(shard_differences, RESULT)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= RANKS))
