"""Matching of readings with predictions, situation analysis and the decision inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators import exposure
from ..operators.asof import match_latest
from ..operators.decisions import DECISION_ORDER
from ..operators.risk import analyse
from ..operators.running import numbered_rows
from ..session import materialise
from .condition import EXPOSED
from .registry import query, rounded
from .tables import Tables

# Seconds a reading stays usable, and a prediction waits for one.
TELEMETRY_AGE, PREDICTION_WAIT = 1800, 900

MATCHED = """
followed as (select *, lead(ts) over (partition by asset_id order by ts, prediction_id) as next_ts from (
  select * from prediction qualify row_number() over (partition by asset_id, ts order by prediction_id) = 1)),
paired as (
 select p.asset_id, p.prediction_id, p.ts as prediction_ts, p.predicted_risk_proxy, p.time_to_failure_hours,
  b.event_id as back_id, b.ts as back_ts, n.event_id as wait_id, n.ts as wait_ts, p.next_ts
 from followed p
 asof left join telemetry b on p.asset_id = b.asset_id and p.ts >= b.ts
 asof left join telemetry n on p.asset_id = n.asset_id and p.ts < n.ts),
matched as (
 select asset_id, prediction_id, prediction_ts, predicted_risk_proxy, time_to_failure_hours,
  case when fresh then back_id else wait_id end as event_id, not fresh as waited,
  case when fresh then prediction_ts else wait_ts end as matched_ts
 from (
  select *, coalesce(epoch_us(prediction_ts) - epoch_us(back_ts) <= {age} * 1000000, false) as fresh,
   coalesce(epoch_us(wait_ts) - epoch_us(prediction_ts) <= {wait} * 1000000 and (next_ts is null or next_ts >= wait_ts), false) as late
  from paired)
 where fresh or late)
"""

DECISION_MATCH = MATCHED.format(age=TELEMETRY_AGE, wait=PREDICTION_WAIT)

CASES = f"""{EXPOSED}, {DECISION_MATCH},
published as (
 select asset_id, event_id, ts, cargo_type, scenario, temperature, humidity, vibration, door_open, refrigeration_failed, risk_proxy, gps_lat, gps_lon,
  profile_cargo, band_low, band_high, hard_low, hard_high, freeze_sensitive, freeze_c,
  {rounded('temp_degree_minutes', 2)} as temp_degree_minutes, {rounded('humidity_percent_minutes', 2)} as humidity_percent_minutes,
  door_open_minutes, vibration_warn_minutes, vibration_critical_minutes,
  {rounded('out_of_range_minutes_in_hour', 2)} as out_of_range_minutes_in_hour
 from exposed),
cases as (
 select e.*, m.prediction_id, m.prediction_ts, m.matched_ts, m.waited, m.time_to_failure_hours,
  m.predicted_risk_proxy as predicted_score, greatest(m.predicted_risk_proxy, e.risk_proxy) as combined_score
 from matched m join published e on m.event_id = e.event_id),
leveled as (
 select *, case when combined_score < 0.40 then 1 when combined_score < 0.75 then 2 when combined_score < 0.95 then 3 else 4 end as base from cases),
analysed as (
 select * exclude (base),
  case when time_to_failure_hours <= 1 then 'critical'
   when time_to_failure_hours <= 3 and lifted < 3 then 'high'
   else ['low', 'moderate', 'high', 'critical'][lifted] end as risk_level,
  combined_score >= 0.40 or refrigeration_failed or temperature < band_low or temperature > band_high or coalesce(time_to_failure_hours <= 6, false) as requires_action,
  case when temperature < band_low then 'below_range' when temperature > band_high then 'above_range' else 'within_range' end as temperature_status,
  list_filter([
   case when temperature < band_low or temperature > band_high then 'temperature_excursion' end,
   case when refrigeration_failed then 'refrigeration_failure' end,
   case when scenario = 'refrigeration_failure' then 'refrigeration_failure_scenario' when scenario <> 'normal' then 'scenario_' || scenario end,
   case when humidity > 85 then 'high_humidity' when humidity < 20 then 'low_humidity' end,
   case when vibration > 5 then 'excessive_vibration' end,
   case when door_open then 'door_open_event' end,
   case when temp_degree_minutes > 0 then 'cumulative_temperature_exposure' end,
   case when humidity_percent_minutes > 0 then 'cumulative_humidity_exposure' end,
   case when door_open_minutes > 0 then 'cumulative_door_open_exposure' end,
   case when vibration_warn_minutes > 0 then 'cumulative_vibration_exposure' end,
   case when vibration_critical_minutes > 0 then 'critical_vibration_exposure' end,
   case when out_of_range_minutes_in_hour > 10 then 'sustained_out_of_range_exposure' end,
   case when time_to_failure_hours <= 6 then 'short_time_to_failure' end], lambda f: f is not null) as factors
 from (select *, case when refrigeration_failed and base < 3 then base + 1 else base end as lifted from leveled))
"""


def published(t: Tables) -> DataFrame:
    """Readings with the exposure values as they are published, two decimals."""
    run = exposure.accumulate(t.telemetry, t.profiles, 5.0)
    return run.select(*t.telemetry.columns, *[round_to(c, 2).alias(c) for c in exposure.EXPOSURE_FIELDS])


def match(t: Tables, age: int = TELEMETRY_AGE, wait: int = PREDICTION_WAIT) -> DataFrame:
    """Predictions with the reading each is decided on; predictions that meet none are dropped.

    Only the reading's id and time take part in the matching. Of predictions with one
    time the first counts, so a repeated one makes no second decision.
    """
    readings = t.telemetry.select("asset_id", "event_id", "ts")
    pairs = match_latest(
        t.prediction, readings, "asset_id", left_order="prediction_id", right_order="event_id", max_age_s=age, wait_s=wait, once=True
    ).filter(F.col("right").isNotNull())
    return pairs.select(
        "left.asset_id",
        "right.event_id",
        "left.prediction_id",
        F.col("left.ts").alias("prediction_ts"),
        "left.predicted_risk_proxy",
        "left.time_to_failure_hours",
        "waited",
        F.greatest("left.ts", "right.ts").alias("matched_ts"),
    )


def cases(t: Tables) -> DataFrame:
    """Analysed cases: reading, exposure, target band and prediction."""
    pairs = match(t).join(published(t), ["asset_id", "event_id"])
    return analyse(exposure.band(exposure.with_profile(pairs, t.profiles)))


def case_table(t: Tables, numbered: bool = False) -> DataFrame:
    """The cases computed once; rerouting and decisions read them several times.

    Cases that are ``numbered`` have their ``decision_no``: here, before offers, texts and documents, their rows are smallest.
    """
    return numbered_rows(cases(t), DECISION_ORDER, "decision_no") if numbered else materialise(cases(t), "cases")


@query(
    "asof_prediction",
    f"with {DECISION_MATCH} select asset_id, prediction_id, event_id, waited, matched_ts from matched",
)
def asof_prediction(t: Tables) -> DataFrame:
    return match(t).select("asset_id", "prediction_id", "event_id", "waited", "matched_ts")


@query(
    "situation_analysis",
    f"""with {CASES} select asset_id, prediction_id, event_id, {rounded('predicted_score', 3)} as predicted_score,
    {rounded('risk_proxy', 3)} as telemetry_score, {rounded('combined_score', 3)} as risk_score, risk_level,
    coalesce(array_to_string(factors, '|'), '') as factors, time_to_failure_hours, requires_action, temperature_status,
    band_low as min_c, band_high as max_c, (band_low + band_high) / 2 as ideal_c,
    temp_degree_minutes, humidity_percent_minutes, out_of_range_minutes_in_hour from analysed""",
)
def situation_analysis(t: Tables) -> DataFrame:
    return cases(t).select(
        "asset_id", "prediction_id", "event_id",
        round_to("predicted_score", 3).alias("predicted_score"),
        round_to("telemetry_score", 3).alias("telemetry_score"),
        "risk_score", "risk_level", F.array_join("contributing_factors", "|").alias("factors"),
        "time_to_failure_hours", "requires_action", "temperature_status",
        F.col("target_low").alias("min_c"), F.col("target_high").alias("max_c"), F.col("target_ideal").alias("ideal_c"),
        "temp_degree_minutes", "humidity_percent_minutes", "out_of_range_minutes_in_hour",
    )
