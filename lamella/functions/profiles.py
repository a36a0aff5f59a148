"""Columns over depth profiles, which are arrays of intensities from the top row down."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quantile(values: Column, share: float) -> Column:
    """Linearly interpolated quantile of an array; an empty or null array gives null."""
    ranked = F.array_sort(values)
    at = F.lit(share) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a = F.get(ranked, low)
    b = F.get(ranked, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def first_crossing(profile: Column, threshold: Column, start: int = 25) -> Column:
    """First row from ``start`` on that is brighter than ``threshold``; null if there is none."""
    bright = F.array_position(F.transform(profile, lambda v, i: (i >= start) & (v > threshold)), F.lit(True))
    return F.when(bright > 0, (bright - 1).cast("int"))


def surface_peak(profile: Column, crossing: Column, window: int = 250, ratio: float = 0.66) -> Column:
    """Row of the surface at or below ``crossing``: the first inner local maximum if it has ``ratio`` of the highest value, else the first highest."""
    part = F.slice(profile, crossing + 1, window)
    top = F.array_max(part)
    inner = F.filter(
        F.transform(part, lambda v, i: F.when((i > 0) & (i < F.size(part) - 1) & (v >= F.get(part, i - 1)) & (v > F.get(part, i + 1)), i)),
        lambda i: i.isNotNull(),
    )
    first = F.get(inner, F.lit(0))
    highest = (F.array_position(part, top) - 1).cast("int")
    return F.when(crossing.isNotNull(), crossing + F.when(F.get(part, first) >= ratio * top, first).otherwise(highest))


def exp2_curve(n: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """``a e^(bz) + c e^(dz)`` at the rows 0 .. n-1."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda z: a * F.exp(b * z) + c * F.exp(d * z))


def sigmoid_curve(n: Column, low: Column, high: Column, k: Column, z0: Column) -> Column:
    """``low + (high - low) / (1 + e^(k (z - z0)))`` at the rows 0 .. n-1."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda z: low + (high - low) / (1 + F.exp(k * (z - z0))))


def grey(magnitude: Column, db_min: float, db_max: float) -> Column:
    """Grey value of an amplitude in a decibel window, not rounded."""
    return F.least(F.greatest(255 * (20 * F.log10(magnitude) - db_min) / (db_max - db_min), F.lit(0.0)), F.lit(255.0))


def intensity_grey(value: Column, db_min: float, db_max: float) -> Column:
    """Grey value of a stored integer intensity in a decibel window, truncated."""
    #: The integers at 20 and 80 dB.
    at_20, at_80 = 1105000000, 1119000000
    slope = (at_80 - at_20) / 60
    low, high = (slope * db + at_20 - slope * 20 for db in (db_min, db_max))
    clipped = F.least(F.greatest(value.cast("double"), F.lit(low)), F.lit(high))
    return (255 * (clipped - low) / (high - low)).cast("int")


def refracted_depth(depth: Column, cavitated: Column, actual_y: Column, reference_y: Column, index: float = 1.5) -> Column:
    """Optical depth over the refractive index; in a cavity, plus the lost height where the reference curve is known."""
    return F.when(cavitated & reference_y.isNotNull(), (actual_y - reference_y) + depth / index).otherwise(depth / index)
