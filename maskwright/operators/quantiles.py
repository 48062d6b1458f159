"""Exact quantiles of groups of any size, without one task seeing a group.

Equal values are counted first; running sums over (group, value), spread over range partitions, tell
which values stand at the two ranks around q * (n - 1), and those are interpolated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.operators.numbering import running_sums
from maskwright.session import cut


def exact_quantiles(rows: DataFrame, group: Sequence[str], value: str, quantiles: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row per group with ``{name: quantile}`` columns; NULL values are left out.

    ``weight`` names a column of how often a row counts. Groups whose values are all NULL have no row.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(n.cast("long").alias("_c"))
    counts = cut(counts)  # read for the bounds of the ranges, the ranges and the totals
    placed = running_sums(counts, group, [F.col("_v")], {"_end": "_c"})
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    if group:
        same = [placed[g].eqNullSafe(totals[g]) for g in group]
        both = placed.join(totals, same).select(*[placed[g] for g in group], "_v", "_c", "_end", "_n")
    else:
        both = placed.crossJoin(F.broadcast(totals))  # one row

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v")))

    aggs = [F.max("_n").alias("_n")]
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("_n") - 1)
        aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    found = both.groupBy(*group).agg(*aggs)
    out = []
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("_n") - 1)
        part, lo, hi = place - F.floor(place), F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part).alias(name))
    return found.select(*group, *out)


def with_quantiles(aggregated: DataFrame, rows: DataFrame, group: Sequence[str], value: str, quantiles: dict[str, float], weight: str | None = None) -> DataFrame:
    """``aggregated`` (one row per group) with the quantiles of ``value`` beside its columns."""
    q = exact_quantiles(rows, group, value, quantiles, weight)
    if not group:
        return aggregated.crossJoin(F.broadcast(q))
    renamed = q.withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = [aggregated[g].eqNullSafe(renamed[f"_g_{g}"]) for g in group]
    return aggregated.join(renamed, same, "left").drop(*[f"_g_{g}" for g in group])
