"""Accumulated exposure, hourly counters and exposure risk per asset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import band_excess, exposure_risk, round_to
from ..functions.values import lower_name
from .running import running

ORDER = ("ts", "event_id")

# Excess is summed in whole millionths, so totals are exact in any order.
MILLIONTHS = 1_000_000

# Parts of a minute an out-of-range tick adds, in twentieths.
OUT_TEMPERATURE, OUT_HUMIDITY, OUT_DOOR, OUT_WHOLE = 20, 5, 4, 20


def with_profile(df: DataFrame, profiles: DataFrame, cargo: str = "cargo_type") -> DataFrame:
    """Join the limits of the cargo type; unknown cargo keeps null limits.

    The profile table has ten fixed rows, so broadcasting it is safe.
    """
    return df.join(F.broadcast(profiles), lower_name(cargo) == F.col("profile_cargo"), "left")


def band(df: DataFrame, unknown: tuple[float, float] = (2.0, 8.0)) -> DataFrame:
    """Target band and ideal temperature, with the default band for unknown cargo."""
    low = F.coalesce("band_low", F.lit(unknown[0]))
    high = F.coalesce("band_high", F.lit(unknown[1]))
    return df.withColumns({"target_low": low, "target_high": high}).withColumn(
        "target_ideal", (F.col("target_low") + F.col("target_high")) / 2.0
    )


def excess(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "temp_excess": F.coalesce(band_excess("temperature", "band_low", "band_high"), F.lit(0.0)),
            "humidity_excess": F.coalesce(band_excess("humidity", "humidity_low", "humidity_high"), F.lit(0.0)),
        }
    )


def _whole(value: Column) -> Column:
    return F.round(value * MILLIONTHS).cast("bigint")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def tick_counters() -> dict[str, Column]:
    """What one reading adds to each running counter, as whole numbers of ticks."""
    return {
        "position": F.lit(1).cast("bigint"),
        "temp_sum": _whole(F.col("temp_excess")),
        "humidity_sum": _whole(F.col("humidity_excess")),
        "door_sum": _flag(F.col("door_open")),
        "warn_sum": _flag(F.col("vibration") >= F.col("vibration_warn")),
        "critical_sum": _flag(F.col("vibration") >= F.col("vibration_critical")),
    }


def out_of_range_units() -> Column:
    return (
        OUT_TEMPERATURE * _flag(F.col("temp_excess") > 0)
        + OUT_HUMIDITY * _flag(F.col("humidity_excess") > 0)
        + OUT_DOOR * _flag(F.col("door_open"))
    )


def ticks_per_hour(dt_min: float) -> int:
    """Readings until a counter that adds ``dt_min`` per reading reaches an hour."""
    return max(1, math.ceil(60.0 / dt_min))


def accumulate(readings: DataFrame, profiles: DataFrame, dt_min: float) -> DataFrame:
    """Running exposure after every reading taken each ``dt_min`` minutes.

    Hourly counters restart on every ``ticks_per_hour`` reading, before that
    reading is added. This closed form needs a fixed interval; the stateful
    stream operator also takes varying ones.
    """
    scored = excess(with_profile(readings, profiles))
    counted = running(scored, "asset_id", ORDER, tick_counters(), previous={"was_open": "door_open"})
    counted = counted.withColumn("hour_no", F.floor(F.col("position") / ticks_per_hour(dt_min)))
    # At most ticks_per_hour rows share one asset and hour number.
    hour = W.partitionBy("asset_id", "hour_no").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    opened = _flag(F.col("door_open") & ~F.coalesce("was_open", F.lit(False)))
    return (
        counted.withColumns(
            {
                "out_units": F.sum(out_of_range_units()).over(hour),
                "door_events_in_hour": F.sum(opened).over(hour),
            }
        )
        .withColumns(
            {
                "total_minutes": F.col("position") * dt_min,
                "temp_degree_minutes": F.col("temp_sum") * dt_min / MILLIONTHS,
                "humidity_percent_minutes": F.col("humidity_sum") * dt_min / MILLIONTHS,
                "door_open_minutes": F.col("door_sum") * dt_min,
                "vibration_warn_minutes": F.col("warn_sum") * dt_min,
                "vibration_critical_minutes": F.col("critical_sum") * dt_min,
                "out_of_range_minutes_in_hour": F.col("out_units") * dt_min / OUT_WHOLE,
                "door_limit_reached": F.col("door_events_in_hour") >= F.col("doors_per_hour"),
            }
        )
        .drop("position", "temp_sum", "humidity_sum", "door_sum", "warn_sum", "critical_sum", "out_units", "was_open")
    )


EXPOSURE_FIELDS = (
    "total_minutes",
    "temp_degree_minutes",
    "humidity_percent_minutes",
    "door_open_minutes",
    "vibration_warn_minutes",
    "vibration_critical_minutes",
    "out_of_range_minutes_in_hour",
)


def exposure_struct() -> Column:
    return F.struct(*[round_to(c, 2).alias(c) for c in EXPOSURE_FIELDS])


def with_risk(exposed: DataFrame) -> DataFrame:
    """Exposure risk 0..1 with three decimals; null for cargo without a profile."""
    risk = exposure_risk(
        "temp_degree_minutes", "humidity_percent_minutes", "door_open_minutes", "vibration_warn_minutes",
        "vibration_critical_minutes", "out_of_range_minutes_in_hour", "temperature",
        "hard_low", "hard_high", "freeze_sensitive", "freeze_c", "allowed_minutes",
    )
    known = F.col("profile_cargo").isNotNull()
    return exposed.withColumn("_risk", F.when(known, risk)).withColumn("exposure_risk", round_to("_risk", 3)).drop("_risk")


def hourly_totals(readings: DataFrame, profiles: DataFrame, dt_min: float, width: str = "1 hour") -> DataFrame:
    """Out-of-range minutes and door-open minutes per asset and clock hour.

    An aggregate with partial sums, usable on tables and on streams.
    """
    scored = excess(with_profile(readings, profiles))
    return (
        scored.groupBy("asset_id", F.window("ts", width).alias("hour"))
        .agg(
            F.count("*").alias("readings"),
            (F.sum(out_of_range_units()) * dt_min / OUT_WHOLE).alias("out_of_range_minutes"),
            (F.sum(_flag(F.col("door_open"))) * dt_min).alias("door_open_minutes"),
        )
        .select("asset_id", F.col("hour.start").alias("hour_start"), "readings", "out_of_range_minutes", "door_open_minutes")
    )
