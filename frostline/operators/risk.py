"""Threshold risk of a reading and analysis of a reading with its prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import plain, round_to
from ..functions.text import kept
from ..functions.values import lower_name, truth, unit

# Defaults for missing sensor fields.
READING_DEFAULTS = {"temperature": 5.0, "humidity": 50.0, "vibration": 0.5, "cargo_type": "vaccines"}

# Texts of the threshold report, by level.
SUMMARIES = {
    "CRITICAL": ("Critical", "Current shipment conditions indicate a high probability of spoilage without immediate intervention."),
    "HIGH": ("High", "Environmental conditions are trending outside control limits and require prompt mitigation."),
    "MEDIUM": ("Moderate", "Some variables are approaching tolerance thresholds and should be monitored closely."),
    "LOW": ("Low", "Shipment conditions are stable and within recommended operating range."),
}
RECOMMENDATIONS = {
    "CRITICAL": "Immediately reduce temperature. Contact logistics team. Consider diverting cargo.",
    "HIGH": "Increase monitoring frequency. Prepare contingency routes. Alert refrigeration team.",
    "MEDIUM": "Monitor conditions closely. Prepare to adjust temperature or route.",
    "LOW": "Maintain current conditions. Continue routine monitoring.",
}

# Risk level thresholds of the situation analysis.
LOW_BELOW, MODERATE_BELOW, HIGH_BELOW = 0.40, 0.75, 0.95
SHORT_FAILURE_HOURS = 6.0


def number_text(value) -> Column:
    """A reading as it appears in messages, up to six decimals, no trailing zeros."""
    return plain(value, 6)


def by_level(level: Column, texts: dict[str, str], otherwise: str) -> Column:
    out = None
    for name, text in texts.items():
        out = F.when(level == name, text) if out is None else out.when(level == name, text)
    return out.otherwise(otherwise)


def threshold_risk(readings: DataFrame) -> DataFrame:
    """Points for readings outside fixed limits: score 0..100, level and warnings.

    Outside 2..8 degrees counts 30 points for vaccines only; the harder
    0..12 limit adds nothing, as every such reading is already counted.
    """
    t, h, v = (F.coalesce(c, F.lit(READING_DEFAULTS[c])) for c in ("temperature", "humidity", "vibration"))
    cargo = F.coalesce("cargo_type", F.lit(READING_DEFAULTS["cargo_type"]))
    warm = (cargo == "vaccines") & ((t < 2.0) | (t > 8.0))
    damp = (h < 30.0) | (h > 60.0)
    rough, severe = v > 2.5, v > 5.0
    points = (
        F.when(warm, 30).otherwise(0) + F.when(damp, 20).otherwise(0)
        + F.when(rough, 20).otherwise(0) + F.when(severe, 30).otherwise(0)
    )
    warnings = kept([
        F.when(warm, F.concat(F.lit("Temperature "), number_text(t), F.lit("°C is outside vaccine range (2-8°C)"))),
        F.when(damp, F.concat(F.lit("Humidity "), number_text(h), F.lit("% is outside optimal range (30-60%)"))),
        F.when(rough, F.concat(F.lit("Vibration "), number_text(v), F.lit("g exceeds warning threshold (2.5g)"))),
        F.when(severe, F.concat(F.lit("CRITICAL: Vibration "), number_text(v), F.lit("g exceeds critical threshold (5.0g)"))),
    ])
    score = F.col("risk_score")
    return readings.withColumns(
        {"risk_score": F.least(points, F.lit(100)), "warnings": warnings}
    ).withColumn(
        "risk_level",
        F.when(score >= 50, "CRITICAL").when(score >= 30, "HIGH").when(score >= 15, "MEDIUM").otherwise("LOW"),
    )


def risk_summary(scored: DataFrame) -> DataFrame:
    """Summary sentence, bulleted warnings and recommendation for each scored reading."""
    level = F.col("risk_level")
    opening = by_level(level, {k: v[0] for k, v in SUMMARIES.items()}, SUMMARIES["LOW"][0])
    closing = by_level(level, {k: v[1] for k, v in SUMMARIES.items()}, SUMMARIES["LOW"][1])
    return scored.withColumns(
        {
            "summary": F.concat(
                opening, F.lit(" risk detected (score: "), F.col("risk_score").cast("string"), F.lit("/100). "), closing
            ),
            "warning_text": F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("• "), w)), "\n"),
            "recommendation": by_level(level, RECOMMENDATIONS, RECOMMENDATIONS["LOW"]),
        }
    )


def base_level(score: Column) -> Column:
    """Level from the score alone."""
    return (
        F.when(score < LOW_BELOW, "low").when(score < MODERATE_BELOW, "moderate")
        .when(score < HIGH_BELOW, "high").otherwise("critical")
    )


def risk_level(score: Column, failed: Column, hours: Column) -> Column:
    """Level from the score, lifted by a cooling failure and by a short time to failure."""
    base = base_level(score)
    lifted = F.when(failed & (base == "low"), "moderate").when(failed & (base == "moderate"), "high").otherwise(base)
    return (
        F.when(hours <= 1.0, "critical")
        .when((hours <= 3.0) & lifted.isin("low", "moderate"), "high")
        .otherwise(lifted)
    )


def analyse(cases: DataFrame) -> DataFrame:
    """Combined risk, level, contributing factors and action need of every case.

    A case is one reading with exposure, target band and its prediction.
    """
    predicted, proxy = F.col("predicted_score"), F.col("telemetry_score")
    score, hours = F.col("combined_score"), F.col("time_to_failure_hours")
    t, h, v = (F.coalesce(c, F.lit(0.0)) for c in ("temperature", "humidity", "vibration"))
    scenario = F.coalesce(lower_name("scenario"), F.lit(""))
    failed, door = truth("refrigeration_failed"), truth("door_open")
    outside = (t < F.col("target_low")) | (t > F.col("target_high"))

    def grown(field: str, limit: float = 0.0) -> Column:
        return F.coalesce(F.col(field), F.lit(0.0)) > limit

    factors = kept([
        F.when(outside, "temperature_excursion"),
        F.when(failed, "refrigeration_failure"),
        F.when(scenario == "refrigeration_failure", "refrigeration_failure_scenario")
        .when((scenario != "") & (scenario != "normal"), F.concat(F.lit("scenario_"), scenario)),
        F.when(h > 85.0, "high_humidity").when(h < 20.0, "low_humidity"),
        F.when(v > 5.0, "excessive_vibration"),
        F.when(door, "door_open_event"),
        F.when(grown("temp_degree_minutes"), "cumulative_temperature_exposure"),
        F.when(grown("humidity_percent_minutes"), "cumulative_humidity_exposure"),
        F.when(grown("door_open_minutes"), "cumulative_door_open_exposure"),
        F.when(grown("vibration_warn_minutes"), "cumulative_vibration_exposure"),
        F.when(grown("vibration_critical_minutes"), "critical_vibration_exposure"),
        F.when(grown("out_of_range_minutes_in_hour", 10.0), "sustained_out_of_range_exposure"),
        F.when(hours <= SHORT_FAILURE_HOURS, "short_time_to_failure"),
    ])
    soon = F.coalesce(hours <= SHORT_FAILURE_HOURS, F.lit(False))
    return (
        cases.withColumns(
            {
                "predicted_score": unit(F.coalesce("predicted_risk_proxy", F.lit(0.0))),
                "telemetry_score": unit(F.coalesce("risk_proxy", F.lit(0.0))),
            }
        )
        .withColumn("combined_score", F.greatest(predicted, proxy))
        .withColumns(
            {
                "risk_score": round_to(score, 3),
                "risk_level": risk_level(score, failed, hours),
                "contributing_factors": factors,
                "requires_action": (score >= LOW_BELOW) | failed | outside | soon,
                "temperature_status": F.when(t < F.col("target_low"), "below_range")
                .when(t > F.col("target_high"), "above_range").otherwise("within_range"),
            }
        )
    )
