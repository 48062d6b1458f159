"""Pixel functions as column expressions: magnitudes, stretches, counts, seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Magnitude limits and zero points of the renderings.
MAG_MIN, MAG_MAX, ZEROPOINT, NONLINEARITY = 20.0, 35.0, 22.5, 300.0


def clean_pixel(mag: Column, bright: float = MAG_MIN, faint: float = MAG_MAX) -> Column:
    """NaN and +inf become the faint limit, -inf the bright one."""
    return (F.when(F.isnan(mag) | (mag == float("inf")) | mag.isNull(), F.lit(faint))
            .when(mag == float("-inf"), F.lit(bright)).otherwise(mag))


def mag_to_flux(mag: Column, zeropoint: float = ZEROPOINT) -> Column:
    return F.pow(F.lit(10.0), (F.lit(zeropoint) - mag) / 2.5)


def asinh_stretch(x: Column, nonlinearity: float = NONLINEARITY) -> Column:
    return F.asinh(x * nonlinearity) / F.asinh(F.lit(nonlinearity))


def quantize(x: Column) -> Column:
    """0..1 to 0..255 by truncation."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255.0)).cast("int")


def linear_magnitude(mag: Column, lo: float = MAG_MIN, hi: float = MAG_MAX) -> Column:
    clipped = F.greatest(F.lit(lo), F.least(F.lit(hi), clean_pixel(mag, lo, hi)))
    return (F.lit(hi) - clipped) / (hi - lo)


def counts_to_sb(counts: Column, zeropoint: float, pix_arcsec: float) -> Column:
    """Counts to surface brightness; counts that are not positive or not finite give 35."""
    sb = -2.5 * F.log10(counts) + zeropoint - 2.5 * F.log10(F.lit(pix_arcsec * pix_arcsec))
    ok = (counts > 0) & ~F.isnan(counts) & (counts < float("inf"))
    return F.when(ok, sb).otherwise(F.lit(35.0))


def sb_sigma(sb_limit: float, pixfov: Column, area: float = 100.0, sn: float = 3.0, zp: float = 0.0) -> Column:
    return pixfov * (area ** 0.5 / sn) * 10 ** (-(sb_limit - zp) / 2.5)


def uniform(seed: Column, *key: Column) -> Column:
    """Number in (0, 1) from a hash of seed and key: the same on any partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(seed, *key), 11).cast("double")
    return (bits + 0.5) / float(1 << 53)


def normal(seed: Column, *key: Column) -> Column:
    u, v = uniform(seed, F.lit(1), *key), uniform(seed, F.lit(2), *key)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(v * 6.283185307179586)


def poisson(mean: Column, seed: Column, *key: Column) -> Column:
    """Poisson draw: inversion below 30, a rounded normal above."""
    u = uniform(seed, F.lit(3), *key)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0.0).alias("k"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, lambda s, k: F.when(s["c"] >= u, s).otherwise(F.struct(
        (s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), k.cast("double").alias("k"))), lambda s: s["k"])
    big = F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * normal(seed, F.lit(4), *key)))
    return F.when(mean < 30, step).otherwise(big)
