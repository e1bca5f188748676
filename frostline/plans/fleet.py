"""Latest state of the fleet: readings, threshold risk, lists, search and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import latest
from ..operators.risk import risk_summary, threshold_risk
from .registry import query
from .tables import Tables

ORDER = ("ts", "event_id")

LATEST = """
latest as (
 select * exclude (rn) from (
  select *, row_number() over (partition by asset_id order by ts desc, event_id desc) as rn from telemetry) where rn = 1)
"""

RISK = """
risk as (
 select *, least(100, points) as risk_score,
  case when points >= 50 then 'CRITICAL' when points >= 30 then 'HIGH' when points >= 15 then 'MEDIUM' else 'LOW' end as risk_level
 from (
  select *,
   (case when cargo_type = 'vaccines' and (temperature < 2 or temperature > 8) then 30 else 0 end)
   + (case when humidity < 30 or humidity > 60 then 20 else 0 end)
   + (case when vibration > 2.5 then 20 else 0 end) + (case when vibration > 5 then 30 else 0 end) as points,
   list_filter([
    case when cargo_type = 'vaccines' and (temperature < 2 or temperature > 8)
     then 'Temperature ' || cast(temperature as varchar) || '°C is outside vaccine range (2-8°C)' end,
    case when humidity < 30 or humidity > 60 then 'Humidity ' || cast(humidity as varchar) || '% is outside optimal range (30-60%)' end,
    case when vibration > 2.5 then 'Vibration ' || cast(vibration as varchar) || 'g exceeds warning threshold (2.5g)' end,
    case when vibration > 5 then 'CRITICAL: Vibration ' || cast(vibration as varchar) || 'g exceeds critical threshold (5.0g)' end
   ], lambda w: w is not null) as warnings
  from {source}))
"""

SUMMARY = """
select asset_id, ts, cast(risk_score as integer) as risk_score, risk_level,
 case risk_level
  when 'CRITICAL' then 'Critical risk detected (score: ' || risk_score || '/100). Current shipment conditions indicate a high probability of spoilage without immediate intervention.'
  when 'HIGH' then 'High risk detected (score: ' || risk_score || '/100). Environmental conditions are trending outside control limits and require prompt mitigation.'
  when 'MEDIUM' then 'Moderate risk detected (score: ' || risk_score || '/100). Some variables are approaching tolerance thresholds and should be monitored closely.'
  else 'Low risk detected (score: ' || risk_score || '/100). Shipment conditions are stable and within recommended operating range.' end as summary,
 coalesce(array_to_string(list_transform(warnings, lambda w: '• ' || w), chr(10)), '') as warning_text,
 case risk_level when 'CRITICAL' then 'Immediately reduce temperature. Contact logistics team. Consider diverting cargo.'
  when 'HIGH' then 'Increase monitoring frequency. Prepare contingency routes. Alert refrigeration team.'
  when 'MEDIUM' then 'Monitor conditions closely. Prepare to adjust temperature or route.'
  else 'Maintain current conditions. Continue routine monitoring.' end as recommendation
from risk
"""

READING = "asset_id, event_id, ts, cargo_type, scenario, temperature, humidity, vibration, door_open, refrigeration_failed"
READING_COLUMNS = READING.split(", ")


def latest_readings(t: Tables) -> DataFrame:
    return latest.latest_by(t.telemetry, ["asset_id"], ORDER)


@query("latest_per_asset", f"with {LATEST} select {READING} from latest")
def latest_per_asset(t: Tables) -> DataFrame:
    return latest_readings(t).select(*READING_COLUMNS)


@query(
    "threshold_risk",
    f"with {RISK.format(source='telemetry')} select asset_id, event_id, ts, cast(risk_score as integer) as risk_score, risk_level, "
    "coalesce(array_to_string(warnings, '|'), '') as warnings from risk",
)
def threshold_risk_all(t: Tables) -> DataFrame:
    return threshold_risk(t.telemetry).select(
        "asset_id", "event_id", "ts", "risk_score", "risk_level", F.array_join("warnings", "|").alias("warnings")
    )


SUMMARY_COLUMNS = ["asset_id", "ts", "risk_score", "risk_level", "summary", "warning_text", "recommendation"]


@query("risk_summary", f"with {LATEST}, {RISK.format(source='latest')} {SUMMARY}")
def risk_summary_latest(t: Tables) -> DataFrame:
    """Latest reading of every truck, its threshold risk and the summary shown for it."""
    return risk_summary(threshold_risk(latest_readings(t))).select(*SUMMARY_COLUMNS)


@query(
    "recent_100",
    f"select {READING} from telemetry order by ts desc, event_id desc limit 100",
)
def recent_100(t: Tables) -> DataFrame:
    return latest.recent(t.telemetry, [F.desc("ts"), F.desc("event_id")], 100).select(*READING_COLUMNS)


@query(
    "recent_assets",
    f"""with newest as (select * from telemetry order by ts desc, event_id desc limit 100)
    select {READING} from (select *, row_number() over (partition by asset_id order by ts desc, event_id desc) as rn from newest) where rn = 1""",
)
def recent_assets(t: Tables) -> DataFrame:
    """The trucks of the newest 100 readings, each with its newest one."""
    newest = latest.recent(t.telemetry, [F.desc("ts"), F.desc("event_id")], 100)
    return latest.latest_by(newest, ["asset_id"], ORDER).select(*READING_COLUMNS)


@query(
    "fleet_search",
    f"""with {LATEST} select {READING} from latest
    where contains(lower(asset_id), lower('Food')) or contains(lower(cargo_type), lower('Food'))""",
)
def fleet_search(t: Tables) -> DataFrame:
    return latest.search(latest_readings(t), "Food", ["asset_id", "cargo_type"]).select(*READING_COLUMNS)


@query(
    "asset_lookup",
    f"select {READING} from telemetry where asset_id = 'TRUCK_00007' ",
)
def asset_lookup(t: Tables) -> DataFrame:
    return latest.lookup(t.telemetry, "TRUCK_00007").select(*READING_COLUMNS)


@query(
    "table_counts",
    """select 'telemetry' as table_name, count(*) as rows from telemetry union all
    select 'predictions', count(*) from prediction union all
    select 'centres', count(*) from centre union all
    select 'documents', count(*) from documents""",
)
def table_counts(t: Tables) -> DataFrame:
    return latest.row_counts(
        {"telemetry": t.telemetry, "predictions": t.prediction, "centres": t.centre, "documents": t.read("documents")}
    )


@query(
    "fleet_size",
    "select count(*) as readings, count(distinct asset_id) as assets from telemetry",
)
def fleet_size(t: Tables) -> DataFrame:
    """Readings and assets; readings are first counted per asset, so the distinct step sees one row each."""
    per_asset = t.telemetry.groupBy("asset_id").agg(F.count("*").alias("n"))
    return per_asset.agg(F.sum("n").alias("readings"), F.count("*").alias("assets"))


@query(
    "changed_events",
    """select asset_id, event_id, ts, door_open from (
     select *, lag(door_open) over (partition by asset_id order by ts, event_id) as before from telemetry)
    where before is null or before <> door_open""",
)
def changed_events(t: Tables) -> DataFrame:
    """Readings whose door state differs from the reading before."""
    picked = t.telemetry.select("asset_id", "event_id", "ts", "door_open")
    return latest.changed(picked, "asset_id", "door_open", ORDER)


@query(
    "service_status",
    """select service_id, status, ts from (
     select *, row_number() over (partition by service_id order by ts desc, event_id desc) as rn from status) where rn = 1""",
)
def service_status(t: Tables) -> DataFrame:
    return latest.latest_by(t.status, ["service_id"], ORDER).select("service_id", "status", "ts")
