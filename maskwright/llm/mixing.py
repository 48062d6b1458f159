"""Mixing sources to target weights: whole-number copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from maskwright.llm.common import WORD, as_text, packed, unit_draw, unpacked

#: Up to this many sources the table of rates is sent to every task; beyond it Spark joins by source.
BROADCAST_SOURCES = 10_000
SEED = 20_240_817


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__size``: the number of words of the text, 0 for null."""
    return docs.withColumn("__size", F.regexp_count(as_text(text), F.lit(WORD)).cast("long"))


def source_targets(docs: DataFrame, source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_rate: float = 3.0) -> DataFrame:
    """One row per source: ``__source, __source_size, __target, __rate``.

    Sources by code point, null last, get the ``weights`` in turn and share the words of all sources.
    A target stops at ``max_rate`` times its source's words; what is over goes to the others by
    weight. With the level t = target / weight of the free sources, a source is at its stop when
    stop / weight <= t; so with sources sorted by stop / weight, the level after the first k have
    stopped is (all words - their stops) / (weight of the rest), and the level that holds is the
    first one below the next source's stop / weight. Sources without words have target and rate 0.
    """
    sums = docs.groupBy(F.col(source).alias("__source")).agg(F.sum("__size").alias("__source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())) - 1) % len(weights)
    table = sums.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    table = table.withColumn("__stop", F.lit(max_rate) * F.col("__source_size")).withColumn("__at", F.col("__stop") / F.col("__weight"))
    by_stop = W.orderBy("__at", F.col("__source").asc_nulls_last())
    whole = by_stop.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("__source_size").over(whole) - F.coalesce(F.sum("__stop").over(before), F.lit(0.0))) / (
        F.sum("__weight").over(whole) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    )
    table = table.withColumn("__level", level)
    table = table.withColumn("__level", F.first(F.when(F.col("__level") <= F.col("__at"), F.col("__level")), ignorenulls=True).over(whole))
    table = table.withColumn("__target", F.least("__stop", F.coalesce(F.col("__level"), F.lit(0.0)) * F.col("__weight")))
    rate = F.coalesce(F.try_divide("__target", "__source_size"), F.lit(0.0))
    return table.select("__source", "__source_size", "__target", F.least(rate, F.lit(max_rate)).alias("__rate"))


def copies(docs: DataFrame, source: str = "source", key: tuple[str, ...] = ("doc_id", "text"), seed: int = SEED, **options) -> DataFrame:
    """Add ``__size, __source_size, __target, __copies`` to every row.

    A row is taken floor(rate) times, and once more when its draw, a hash of the seed and ``key``, is
    below the rate's fraction. Rows that repeat id and text repeat the draw. A null source is a
    source of its own. No row is dropped: rows with zero copies stay, with 0. Only SQL functions.
    """
    rows = sized(docs)
    table = source_targets(rows, source, **options)
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    out = rows.join(table, F.col(f"`{source}`").eqNullSafe(F.col("__source")), "left")
    whole = F.floor("__rate")
    draw = unit_draw(seed, *key) < F.col("__rate") - whole
    return out.withColumn("__copies", (whole + draw.cast("long")).cast("long")).drop("__source", "__rate")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row as often as it is taken, with the columns of ``docs``.

    Texts without words and null texts have size 0; they follow their source's rate like others.
    """
    picked = copies(packed(docs, "doc_id", "text", "source"), **options).where("__copies > 0")
    return unpacked(picked.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))))
