"""Cooling recommendation, command and plan of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import plain, round_to
from ..functions.text import kept
from ..functions.values import clamp, lower_name, truth

# Accepted spellings of each cooling action.
ACTION_NAMES = {
    "increase_cooling": "increase_cooling",
    "increasecooling": "increase_cooling",
    "decrease_cooling": "decrease_cooling",
    "decreasecooling": "decrease_cooling",
    "max_cooling": "max_cooling",
    "maxcooling": "max_cooling",
    "eco_mode": "eco_mode",
    "ecomode": "eco_mode",
    "emergency_mode": "emergency_mode",
    "emergencymode": "emergency_mode",
    "hold": "hold",
    "monitor": "hold",
    "normal": "hold",
}

# Temperature change and power change in percent of each action.
ACTION_EFFECTS = {
    "increase_cooling": (-2.0, 20.0),
    "decrease_cooling": (1.0, -10.0),
    "max_cooling": (-5.0, 50.0),
    "eco_mode": (0.5, -30.0),
    "emergency_mode": (-8.0, 100.0),
    "hold": (0.0, 0.0),
}

# Minutes needed per degree of change.
MINUTES_PER_DEGREE = 15.0


def lookup(table: dict, key: Column, value=lambda v: v) -> Column:
    pairs = [F.lit(x) for name, entry in table.items() for x in (name, value(entry))]
    return F.try_element_at(F.create_map(*pairs), key)


def action_name(action) -> Column:
    """Canonical action, null for an unknown one."""
    return lookup(ACTION_NAMES, F.lower(F.trim(action if isinstance(action, Column) else F.col(action))))


def recommended_action(
    temperature: Column, risk: Column, failed: Column, scenario: Column, rate_per_hour: Column | None = None
) -> Column:
    """First rule that fits, for cargo with a profile and for unknown cargo."""
    rate = F.coalesce(rate_per_hour, F.lit(0.0)) if rate_per_hour is not None else F.lit(0.0)
    low, high, freeze = F.col("band_low"), F.col("band_high"), F.col("freeze_c")
    sensitive = F.coalesce(F.col("freeze_sensitive"), F.lit(False))
    trouble = failed | (scenario == "refrigeration_failure")
    known = (
        F.when(sensitive & (temperature <= freeze), "decrease_cooling")
        .when(trouble & ((temperature >= high) | (risk >= 0.40)), "emergency_mode")
        .when(trouble & (rate >= 2.0), "max_cooling")
        .when(sensitive & (temperature <= freeze + 0.5), "decrease_cooling")
        .when(temperature < low - 1.5, "decrease_cooling")
        .when(temperature.between(low, high) & (risk < 0.20), "eco_mode")
        .otherwise("hold")
    )
    off = temperature - F.col("target_ideal")
    unknown = (
        F.when(failed & ((risk >= 0.40) | (off > 1.0)), "emergency_mode")
        .when(risk >= 0.85, "emergency_mode")
        .when((risk >= 0.65) | (off >= 5.0), "max_cooling")
        .when((risk >= 0.40) | (off >= 2.0), "increase_cooling")
        .when(off <= -1.0, "decrease_cooling")
        .when((F.abs(off) <= 0.5) & (risk < 0.20), "eco_mode")
        .otherwise("hold")
    )
    return F.when(F.col("profile_cargo").isNotNull(), known).otherwise(unknown)


def safe_target(temperature: Column, action: Column) -> Column:
    """Temperature after the action, inside the hard limits and above freezing where that matters."""
    moved = temperature + lookup(ACTION_EFFECTS, action, lambda e: e[0])
    held = clamp(moved, F.col("hard_low"), F.col("hard_high"))
    thawed = F.when(
        F.col("freeze_sensitive") & (held <= F.col("freeze_c")),
        F.greatest(F.col("freeze_c") + 0.5, F.col("hard_low")),
    ).otherwise(held)
    return round_to(F.when(F.col("profile_cargo").isNotNull(), thawed).otherwise(moved), 2)


def command(requested: Column, target: Column) -> Column:
    """The command for a requested action; an unsupported one gives an error.

    ``target`` is the column of ``safe_target`` for the same action.
    """
    action = action_name(requested)
    known = F.col("profile_cargo").isNotNull()
    temperature = F.coalesce(F.col("temperature"), F.lit(0.0))
    failed = truth("refrigeration_failed")
    notes = kept([
        F.when(action == "emergency_mode", "Emergency cooling requested"),
        F.when(failed, "Refrigeration failure context detected; backup or manual intervention may be required"),
        F.when(known & F.col("freeze_sensitive") & (target <= F.col("freeze_c") + 0.5), "Freeze-sensitive cargo protection applied"),
        F.when(known & (target < F.col("band_low")), "Target remains below preferred cargo band; monitor for overcooling"),
        F.when(known & (target > F.col("band_high")), "Target remains above preferred cargo band; continued intervention may be needed"),
    ])
    good = action.isNotNull()

    def if_good(value: Column) -> Column:
        return F.when(good, value)

    return F.struct(
        good.alias("success"),
        action.alias("action"),
        requested.alias("requested_action"),
        if_good(F.coalesce("profile_cargo", F.lit("unknown"))).alias("cargo_type"),
        if_good(round_to(temperature, 2)).alias("current_temp"),
        if_good(target).alias("target_temp"),
        lookup(ACTION_EFFECTS, action, lambda e: e[1]).alias("power_change_pct"),
        if_good(round_to(F.abs(target - temperature) * MINUTES_PER_DEGREE, 2)).alias("estimated_time_minutes"),
        if_good(F.col("target_low")).alias("range_min_c"),
        if_good(F.col("target_high")).alias("range_max_c"),
        if_good(failed).alias("refrigeration_failed"),
        if_good(F.coalesce("scenario", F.lit(""))).alias("scenario"),
        if_good(notes).alias("notes"),
        F.when(~good, F.concat(F.lit("Unsupported action: "), F.coalesce(requested, F.lit("None")))).alias("error"),
    )


def adjust(cases: DataFrame, requested: str, name: str = "command") -> DataFrame:
    """Add the command for the action named in column ``requested``."""
    temperature = F.coalesce(F.col("temperature"), F.lit(0.0))
    target = f"_{name}_target"
    return (
        cases.withColumn(target, safe_target(temperature, action_name(requested)))
        .withColumn(name, command(F.col(requested), F.col(target)))
        .drop(target)
    )


def plan(cases: DataFrame) -> DataFrame:
    """Recommended action with its command preview and rationale, for analysed cases."""
    temperature = F.coalesce(F.col("temperature"), F.lit(0.0))
    risk, hours = F.col("combined_score"), F.col("time_to_failure_hours")
    scenario = F.coalesce(lower_name("scenario"), F.lit(""))
    failed = truth("refrigeration_failed")
    degree_minutes = F.coalesce("temp_degree_minutes", F.lit(0.0))
    rationale = kept([
        F.when(temperature > F.col("target_high"), "Temperature is above the preferred cargo range")
        .when(temperature < F.col("target_low"), "Temperature is below the preferred cargo range")
        .otherwise("Temperature is within the preferred cargo range"),
        F.when(risk >= 0.75, "Predicted spoilage risk is high").when(risk >= 0.40, "Predicted spoilage risk is moderate"),
        F.when(failed, "Refrigeration failure flag is active"),
        F.when(scenario == "refrigeration_failure", "Shipment is in refrigeration-failure scenario"),
        F.when(
            degree_minutes > 0,
            F.concat(F.lit("Cumulative temperature exposure detected: "), plain(degree_minutes, 2), F.lit(" degree-minutes")),
        ),
        F.when(truth("door_open"), "Door is currently open, which may worsen thermal drift"),
        F.when(hours.isNotNull(), F.concat(F.lit("Estimated time to failure: "), plain(hours, 2), F.lit(" hours"))),
    ])
    chosen = cases.withColumns(
        {"recommended_action": recommended_action(temperature, risk, failed, scenario), "cooling_rationale": rationale}
    )
    return adjust(chosen, "recommended_action", "command_preview")


