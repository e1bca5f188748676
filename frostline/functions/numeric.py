"""Numeric column expressions shared by the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import as_column, clamp

EARTH_RADIUS_KM = 6371.0

# 2**27 + 1: splits a double into two halves whose products with 10**digits are exact.
_SPLITTER = 134217729.0


def round_to(value, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    ``F.round`` rounds the printed decimal instead, so 1.005 becomes 1.01
    there and 1.0 here. ``rint`` is right unless the scaled value lands on a
    half only because of its own rounding error; then the error decides.
    """
    x = as_column(value)
    scale = float(10**digits)
    scaled = x * F.lit(scale)
    nearest = F.rint(scaled)
    high = x * F.lit(_SPLITTER) - (x * F.lit(_SPLITTER) - x)
    error = (high * F.lit(scale) - scaled) + (x - high) * F.lit(scale)
    off = scaled - nearest
    wrong = (F.abs(off) == 0.5) & (error * off > 0)
    return (nearest + F.when(wrong, off * 2.0).otherwise(0.0)) / F.lit(scale)


def plain(value, digits: int) -> Column:
    """Shortest text of a number rounded to ``digits``, with at least one decimal."""
    return F.regexp_replace(fixed(value, digits), r"(\.\d+?)0+$", "$1")


def fixed(value, digits: int) -> Column:
    """Text with exactly ``digits`` decimals."""
    return round_to(value, digits).cast(f"decimal(30,{digits})").cast("string")


def lerp(a, b, share) -> Column:
    return as_column(a) + (as_column(b) - as_column(a)) * as_column(share)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (as_column(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def band_excess(value, low, high) -> Column:
    """Distance outside a band, 0 inside."""
    value, low, high = (as_column(c) for c in (value, low, high))
    return F.greatest(low - value, value - high, F.lit(0.0))


def saturating(amount, scale: float) -> Column:
    """1 - exp(-amount / scale)."""
    return F.lit(1.0) - F.exp(-as_column(amount) / F.lit(scale))


def exposure_risk(
    temp_degree, humidity, door, vib_warn, vib_critical, out_of_range, temperature,
    hard_low, hard_high, freeze_sensitive, freeze_c, allowed_minutes,
) -> Column:
    """Spoilage risk 0..1 from accumulated exposure plus penalties for the current reading."""
    temperature, hard_low, hard_high, allowed = (
        as_column(c) for c in (temperature, hard_low, hard_high, allowed_minutes)
    )
    out_of_range = as_column(out_of_range)
    base = (
        F.lit(0.55) * saturating(temp_degree, 120.0)
        + F.lit(0.15) * saturating(humidity, 600.0)
        + F.lit(0.15) * saturating(door, 20.0)
        + F.lit(0.15) * saturating(as_column(vib_warn) + 2.0 * as_column(vib_critical), 30.0)
    )
    too_cold = F.when(temperature < hard_low, F.least(F.lit(0.25), (hard_low - temperature) / 10.0)).otherwise(0.0)
    too_warm = F.when(temperature > hard_high, F.least(F.lit(0.25), (temperature - hard_high) / 10.0)).otherwise(0.0)
    frozen = F.when(as_column(freeze_sensitive) & (temperature <= as_column(freeze_c)), 0.30).otherwise(0.0)
    sustained = F.when(out_of_range > allowed, F.least(F.lit(0.20), (out_of_range - allowed) / 60.0)).otherwise(0.0)
    return clamp(base + (too_cold + too_warm + frozen + sustained), 0.0, 1.0)


def failure_hours(risk) -> Column:
    """Estimated hours to failure: 72 at no risk down to 6 at full risk, one decimal."""
    hours = F.lit(72.0) - clamp(risk, 0.0, 1.0) * F.lit(66.0)
    return round_to(clamp(hours, 6.0, 72.0), 1)
