"""Masks as 64-bit tile rows: one whole number per (keys, y, tile) whose bit k says whether pixel 64 * tile + k is set.

Union is ``bit_or``, which Spark combines before the shuffle, areas are ``bit_count``, differences and erosions
shifts and masks, so plans that end in counts need one aggregation and no window, sort or collected list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.operators.runs import BAND, IMAGE, MASK, TILE, tile_runs

assert TILE == 64  # one long


def run_bits() -> Column:
    """Bits of a run (x0, x1) that lies inside ``tile``."""
    return F.expr(f"shiftleft(shiftrightunsigned(-1L, 64 - (x1 - x0)), cast(x0 - tile * {TILE} as int))")


def tile_rows(runs: DataFrame, keys: Sequence[str] = MASK, name: str = "bits") -> DataFrame:
    """Union of the runs under ``keys`` as rows (keys, y, tile, bits)."""
    return tile_runs(runs).groupBy(*keys, "y", "tile").agg(F.bit_or(run_bits()).alias(name))


BLOCK = ["image_id", "band", "tile"]


def mask_blocks(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Masks cut into blocks of ``BAND`` rows and one tile: (keys, band, tile, lo, hi, bits), where ``bits`` holds a long for
    every row from ``lo`` to ``hi``, empty ones included.

    One row per mask and block instead of one per run is what makes masks cheap to shuffle; rows that are partitioned by
    mask are not moved for it.
    """
    rows = tile_rows(runs, keys).withColumn("band", F.expr(f"cast(floor(y / {BAND}) as int)"))
    lists = rows.groupBy(*keys, "band", "tile").agg(F.sort_array(F.collect_list(F.struct("y", "bits"))).alias("r"))
    ends = lists.withColumns({"lo": F.expr("r[0].y"), "hi": F.expr("r[size(r) - 1].y")})
    bits = F.expr("case when size(r) = hi - lo + 1 then r.bits "
                  "else transform(sequence(lo, hi), v -> coalesce(get(filter(r, s -> s.y = v), 0).bits, 0L)) end")
    return ends.select(*keys, "band", "tile", "lo", "hi", bits.alias("bits"))


def block_rows(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tile rows (keys, band, tile, y, bits) of blocks."""
    rows = blocks.select(*keys, "band", "tile", "lo", F.posexplode("bits"))
    return rows.select(*keys, "band", "tile", (F.col("lo") + F.col("pos")).cast("int").alias("y"), F.col("col").alias("bits")).where("bits <> 0")


def shared_pixels() -> Column:
    """Pixels that the block (lo, hi, bits) shares with the block (_lo, _hi, _bits) of the same place."""
    return F.expr("aggregate(case when greatest(lo, _lo) <= least(hi, _hi) then sequence(greatest(lo, _lo), least(hi, _hi)) else array() end, 0L, "
                  "(s, v) -> s + bit_count(element_at(bits, v - lo + 1) & element_at(_bits, v - _lo + 1)))")


def pixels(bits: Column) -> Column:
    return F.bit_count(bits).cast("long")


def bit_areas(rows: DataFrame, keys: Sequence[str] = MASK, name: str = "area") -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(pixels(F.col("bits"))).alias(name))


def two_sides(a: DataFrame, b: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Unions of both sides beside each other: (keys, y, tile, a, b), zero where a side has nothing."""
    none = F.lit(0).cast("long")
    left = tile_runs(a).select(*keys, "y", "tile", run_bits().alias("a"), none.alias("b"))
    right = tile_runs(b).select(*keys, "y", "tile", none.alias("a"), run_bits().alias("b"))
    return left.unionByName(right).groupBy(*keys, "y", "tile").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))


def side_counts(a: DataFrame, b: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """``keys, both, only_a, only_b``: pixels of the unions of two sides."""
    one, two = F.col("a"), F.col("b")
    return two_sides(a, b, keys).groupBy(*keys).agg(
        F.sum(pixels(one.bitwiseAND(two))).alias("both"), F.sum(pixels(one.bitwiseAND(F.bitwise_not(two)))).alias("only_a"),
        F.sum(pixels(two.bitwiseAND(F.bitwise_not(one)))).alias("only_b"))


def shared_bits(rows: DataFrame, union: DataFrame, keys: Sequence[str] = MASK, on: Sequence[str] = IMAGE, name: str = "inter") -> DataFrame:
    """Pixels of each mask of ``rows`` that the union (on, y, tile, bits) covers; masks without any have no row."""
    right = union.select(*on, "y", "tile", F.col("bits").alias("_u"))
    hit = rows.join(right, [*on, "y", "tile"])
    return hit.groupBy(*keys).agg(F.sum(pixels(F.col("bits").bitwiseAND(F.col("_u")))).alias(name)).where(F.col(name) > 0)


def without(rows: DataFrame, union: DataFrame, on: Sequence[str] = IMAGE) -> DataFrame:
    """Rows less the pixels of the union (on, y, tile, bits); rows that lose all are left out."""
    right = union.select(*on, "y", "tile", F.col("bits").alias("_u"))
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_u", F.lit(0).cast("long"))))
    return rows.join(right, [*on, "y", "tile"], "left").withColumn("bits", left).drop("_u").where("bits <> 0")


def inner_boundary(rows: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Rows less their 4-neighbour erosion; outside the frame counts as unset.

    Every row sends what its neighbours need (itself up and down, its edge bits to both sides), and one aggregation
    brings it together: no join of a mask with itself.
    """
    bits, none = F.col("bits"), F.lit(0).cast("long")

    def sent(dy: int, dtile: int, **what: Column) -> Column:
        return F.struct((F.col("y") + dy).cast("int").alias("y"), (F.col("tile") + dtile).cast("long").alias("tile"),
                        *[what.get(n, none).alias(n) for n in ("own", "above", "below", "left", "right")])

    messages = F.array(
        sent(0, 0, own=bits, left=F.shiftleft(bits, 1), right=F.shiftrightunsigned(bits, 1)), sent(1, 0, above=bits), sent(-1, 0, below=bits),
        sent(0, 1, left=F.shiftrightunsigned(bits, 63)), sent(0, -1, right=F.shiftleft(bits, 63)))
    met = rows.select(*keys, F.explode(messages).alias("m")).select(*keys, "m.*").groupBy(*keys, "y", "tile").agg(
        *[F.bit_or(n).alias(n) for n in ("own", "above", "below", "left", "right")])
    core = F.col("above")
    for n in ("below", "left", "right"):
        core = core.bitwiseAND(F.col(n))
    return met.withColumn("bits", F.col("own").bitwiseAND(F.bitwise_not(core))).where("bits <> 0").select(*keys, "y", "tile", "bits")


def runs_of(rows: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Runs of tile rows, cut at tile borders: the k-th start belongs to the k-th end.

    The place of a k-th bit is the greatest one with fewer than k bits below it, found in six halvings: plain arithmetic
    on longs, which Spark compiles, where functions on arrays are interpreted.
    """
    bits = F.col("bits")
    starts, ends = bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1))), bits.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(bits, 1)))
    at = rows.where("bits <> 0").select(*keys, "y", "tile", starts.alias("_starts"), ends.alias("_ends"))
    at = at.select("*", F.explode(F.expr("sequence(1, bit_count(_starts))")).alias("_k"), F.lit(0).alias("_s"), F.lit(0).alias("_e"))
    for step in (32, 16, 8, 4, 2, 1):
        at = at.withColumns({p: F.expr(f"{p} + case when bit_count({of} & shiftrightunsigned(-1L, {TILE - step} - {p})) < _k then {step} else 0 end")
                             for p, of in (("_s", "_starts"), ("_e", "_ends"))})
    return at.select(*keys, "y", "tile", F.expr(f"cast(tile * {TILE} + _s as int)").alias("x0"), F.expr(f"cast(tile * {TILE} + _e + 1 as int)").alias("x1"))
