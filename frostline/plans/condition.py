"""Exposure, hourly counters, exposure risk and normalised readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import failure_hours, round_to
from ..operators import exposure, hourly, running
from .registry import query, rounded
from .tables import Tables

# Minutes between two readings of an asset.
DT = 5.0
TICKS = 12

SCORED = """
scored as (
 select t.*, p.* exclude (cargo_no),
  greatest(p.band_low - t.temperature, t.temperature - p.band_high, 0.0) as temp_excess,
  greatest(p.humidity_low - t.humidity, t.humidity - p.humidity_high, 0.0) as humidity_excess
 from telemetry t join cargo_no p on t.cargo_type = p.profile_cargo)
"""

EXPOSED = f"""{SCORED},
counted as (
 select *, row_number() over w as position,
  sum(cast(round(temp_excess * 1000000) as bigint)) over w as temp_sum,
  sum(cast(round(humidity_excess * 1000000) as bigint)) over w as humidity_sum,
  sum(cast(door_open as bigint)) over w as door_sum,
  sum(cast(vibration >= vibration_warn as bigint)) over w as warn_sum,
  sum(cast(vibration >= vibration_critical as bigint)) over w as critical_sum,
  lag(door_open) over w as was_open
 from scored window w as (partition by asset_id order by ts, event_id)),
hourly as (
 select *, position // {TICKS} as hour_no,
  20 * cast(temp_excess > 0 as bigint) + 5 * cast(humidity_excess > 0 as bigint) + 4 * cast(door_open as bigint) as units
 from counted),
exposed as (
 select *, position * cast({DT} as double) as total_minutes,
  cast(temp_sum as double) * {DT} / 1000000 as temp_degree_minutes,
  cast(humidity_sum as double) * {DT} / 1000000 as humidity_percent_minutes,
  cast(door_sum as double) * {DT} as door_open_minutes,
  cast(warn_sum as double) * {DT} as vibration_warn_minutes,
  cast(critical_sum as double) * {DT} as vibration_critical_minutes,
  cast(sum(units) over h as double) * {DT} / 20 as out_of_range_minutes_in_hour,
  cast(sum(cast(door_open and not coalesce(was_open, false) as bigint)) over h as bigint) as door_events_in_hour
 from hourly window h as (partition by asset_id, hour_no order by ts, event_id))
"""

RISK_VALUE = """
least(1.0, greatest(0.0,
 0.55 * (1 - exp(-temp_degree_minutes / 120)) + 0.15 * (1 - exp(-humidity_percent_minutes / 600))
 + 0.15 * (1 - exp(-door_open_minutes / 20)) + 0.15 * (1 - exp(-(vibration_warn_minutes + 2 * vibration_critical_minutes) / 30))
 + case when temperature < hard_low then least(0.25, (hard_low - temperature) / 10) else 0 end
 + case when temperature > hard_high then least(0.25, (temperature - hard_high) / 10) else 0 end
 + case when freeze_sensitive and temperature <= freeze_c then 0.30 else 0 end
 + case when out_of_range_minutes_in_hour > allowed_minutes then least(0.20, (out_of_range_minutes_in_hour - allowed_minutes) / 60) else 0 end))
"""

KEYS = "asset_id, event_id, ts"
KEY_COLUMNS = KEYS.split(", ")


def exposed(t: Tables) -> DataFrame:
    return exposure.accumulate(t.telemetry, t.profiles, DT)


@query(
    "band_excess",
    f"with {SCORED} select {KEYS}, {rounded('temp_excess', 6)} as temp_excess, {rounded('humidity_excess', 6)} as humidity_excess from scored",
)
def band_excess(t: Tables) -> DataFrame:
    scored = exposure.excess(exposure.with_profile(t.telemetry, t.profiles))
    return scored.select(
        *KEY_COLUMNS, round_to("temp_excess", 6).alias("temp_excess"), round_to("humidity_excess", 6).alias("humidity_excess")
    )


@query(
    "cumulative_exposure",
    f"""with {EXPOSED} select {KEYS}, total_minutes, temp_degree_minutes, humidity_percent_minutes, door_open_minutes,
    vibration_warn_minutes, vibration_critical_minutes, out_of_range_minutes_in_hour from exposed""",
)
def cumulative_exposure(t: Tables) -> DataFrame:
    return exposed(t).select(*KEY_COLUMNS, *exposure.EXPOSURE_FIELDS)


@query("hourly_out_of_range", f"with {EXPOSED} select {KEYS}, hour_no, out_of_range_minutes_in_hour from exposed")
def hourly_out_of_range(t: Tables) -> DataFrame:
    return exposed(t).select(*KEY_COLUMNS, "hour_no", "out_of_range_minutes_in_hour")


@query(
    "door_events_hour",
    f"with {EXPOSED} select {KEYS}, door_events_in_hour, door_events_in_hour >= doors_per_hour as door_limit_reached from exposed",
)
def door_events_hour(t: Tables) -> DataFrame:
    return exposed(t).select(*KEY_COLUMNS, "door_events_in_hour", "door_limit_reached")


@query("exposure_risk", f"with {EXPOSED} select {KEYS}, {rounded(RISK_VALUE, 3)} as exposure_risk from exposed")
def exposure_risk(t: Tables) -> DataFrame:
    return exposure.with_risk(exposed(t)).select(*KEY_COLUMNS, "exposure_risk")


@query(
    "clock_hour_exposure",
    f"""with {SCORED} select asset_id, date_trunc('hour', ts) as hour_start, count(*) as readings,
    cast(sum(20 * cast(temp_excess > 0 as bigint) + 5 * cast(humidity_excess > 0 as bigint) + 4 * cast(door_open as bigint)) as double) * {DT} / 20 as out_of_range_minutes,
    cast(sum(cast(door_open as bigint)) as double) * {DT} as door_open_minutes
    from scored group by all""",
)
def clock_hour_exposure(t: Tables) -> DataFrame:
    return exposure.hourly_totals(t.telemetry, t.profiles, DT)


@query(
    "time_to_failure",
    f"select asset_id, prediction_id, {rounded('least(72.0, greatest(6.0, 72.0 - predicted_risk_proxy * 66.0))', 1)} as hours from prediction",
)
def time_to_failure(t: Tables) -> DataFrame:
    return t.prediction.select("asset_id", "prediction_id", failure_hours("predicted_risk_proxy").alias("hours"))


# Minutes that a reading stands for at most, and those of an asset's first.
LONGEST, FIRST = 20, 5


@query(
    "uneven_out_of_range",
    f"""with {SCORED}, steps as (
     select asset_id, event_id, ts, row_number() over w as no,
      coalesce(least({LONGEST * 60_000_000}, epoch_us(ts) - epoch_us(lag(ts) over w)), {FIRST * 60_000_000}) as step,
      20 * cast(temp_excess > 0 as bigint) + 5 * cast(humidity_excess > 0 as bigint) + 4 * cast(door_open as bigint) as units
     from scored window w as (partition by asset_id order by ts, event_id))
    select asset_id, event_id, ts, {rounded('cast(done as double) / 1200000000.0', 4)} as out_of_range_minutes_in_hour from (
     with recursive c as (
      select asset_id, event_id, ts, no, step as hour, units * step as done from steps where no = 1
      union all
      select s.asset_id, s.event_id, s.ts, s.no, case when c.hour + s.step >= {hourly.HOUR} then 0 else c.hour + s.step end,
       case when c.hour + s.step >= {hourly.HOUR} then 0 else c.done end + s.units * s.step
      from c join steps s on s.asset_id = c.asset_id and s.no = c.no + 1)
     select * from c)""",
)
def uneven_out_of_range(t: Tables) -> DataFrame:
    """The hourly counter over the readings as they come, each standing for the time since the one before it."""
    scored = exposure.excess(exposure.with_profile(t.telemetry, t.profiles)).withColumn("units", exposure.out_of_range_units())
    rows = running.running(scored.select(*KEY_COLUMNS, "units"), "asset_id", ["ts", "event_id"], {}, previous={"before": "ts"})
    gap = F.unix_micros("ts") - F.unix_micros("before")
    step = F.coalesce(F.least(F.lit(LONGEST * 60_000_000), gap), F.lit(FIRST * 60_000_000))
    counted = hourly.hourly_counter(rows, "asset_id", ["ts", "event_id"], step, F.col("units"), "done")
    return counted.select(*KEY_COLUMNS, round_to(F.col("done") / 1_200_000_000.0, 4).alias("out_of_range_minutes_in_hour"))
