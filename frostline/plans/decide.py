"""Cooling plans, actions, decision records and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts, cooling, decisions
from ..session import materialise
from .cases import CASES, case_table, cases
from .registry import query, rounded
from .reroute import SCORED
from .tables import Tables

COOLING = """
planned as (
 select *, case
  when freeze_sensitive and temperature <= freeze_c then 'decrease_cooling'
  when (refrigeration_failed or scenario = 'refrigeration_failure') and (temperature >= band_high or combined_score >= 0.40) then 'emergency_mode'
  when freeze_sensitive and temperature <= freeze_c + 0.5 then 'decrease_cooling'
  when temperature < band_low - 1.5 then 'decrease_cooling'
  when temperature >= band_low and temperature <= band_high and combined_score < 0.20 then 'eco_mode'
  else 'hold' end as recommended_action
 from analysed)
"""


def command_sql(source: str, action: str, prefix: str) -> str:
    """Target temperature, power and minutes of an action column, step by step."""
    return f"""
{prefix}moved as (
 select *, temperature + case {action} when 'increase_cooling' then -2.0 when 'decrease_cooling' then 1.0 when 'max_cooling' then -5.0
   when 'eco_mode' then 0.5 when 'emergency_mode' then -8.0 else 0.0 end as {prefix}raw_target,
  cast(case {action} when 'increase_cooling' then 20 when 'decrease_cooling' then -10 when 'max_cooling' then 50
   when 'eco_mode' then -30 when 'emergency_mode' then 100 else 0 end as double) as {prefix}power
 from {source}),
{prefix}held as (select *, greatest(hard_low, least(hard_high, {prefix}raw_target)) as {prefix}clamped from {prefix}moved),
{prefix}commanded as (
 select *, {rounded(f"case when freeze_sensitive and {prefix}clamped <= freeze_c then greatest(freeze_c + 0.5, hard_low) else {prefix}clamped end", 2)} as {prefix}target
 from {prefix}held)
"""


COOLED = f"{CASES}, {COOLING}, {command_sql('planned', 'recommended_action', 'p_')}"


@query(
    "cooling_action",
    f"""with {COOLED} select asset_id, prediction_id, recommended_action,
     array_to_string(list_filter([
      case when temperature > band_high then 'Temperature is above the preferred cargo range'
       when temperature < band_low then 'Temperature is below the preferred cargo range' else 'Temperature is within the preferred cargo range' end,
      case when combined_score >= 0.75 then 'Predicted spoilage risk is high' when combined_score >= 0.40 then 'Predicted spoilage risk is moderate' end,
      case when refrigeration_failed then 'Refrigeration failure flag is active' end,
      case when scenario = 'refrigeration_failure' then 'Shipment is in refrigeration-failure scenario' end,
      case when temp_degree_minutes > 0 then 'Cumulative temperature exposure detected: ' || cast(temp_degree_minutes as varchar) || ' degree-minutes' end,
      case when door_open then 'Door is currently open, which may worsen thermal drift' end,
      case when time_to_failure_hours is not null then 'Estimated time to failure: ' || cast({rounded('time_to_failure_hours', 2)} as varchar) || ' hours' end
     ], lambda r: r is not null), '|') as rationale from p_commanded""",
)
def cooling_action(t: Tables) -> DataFrame:
    return cooling.plan(cases(t)).select(
        "asset_id", "prediction_id", "recommended_action", F.array_join("cooling_rationale", "|").alias("rationale")
    )


@query(
    "cooling_command",
    f"""with {COOLED} select asset_id, prediction_id, recommended_action as action, cargo_type, temperature as current_temp,
     p_target as target_temp, p_power as power_change_pct, {rounded('abs(p_target - temperature) * 15.0', 2)} as estimated_time_minutes,
     band_low as range_min_c, band_high as range_max_c,
     coalesce(array_to_string(list_filter([
      case when recommended_action = 'emergency_mode' then 'Emergency cooling requested' end,
      case when refrigeration_failed then 'Refrigeration failure context detected; backup or manual intervention may be required' end,
      case when freeze_sensitive and p_target <= freeze_c + 0.5 then 'Freeze-sensitive cargo protection applied' end,
      case when p_target < band_low then 'Target remains below preferred cargo band; monitor for overcooling' end,
      case when p_target > band_high then 'Target remains above preferred cargo band; continued intervention may be needed' end
     ], lambda n: n is not null), '|'), '') as notes from p_commanded""",
)
def cooling_command(t: Tables) -> DataFrame:
    c = "command_preview"
    fields = ["action", "cargo_type", "current_temp", "target_temp", "power_change_pct", "estimated_time_minutes",
              "range_min_c", "range_max_c"]
    return cooling.plan(cases(t)).select(
        "asset_id", "prediction_id", *[F.col(f"{c}.{f}").alias(f) for f in fields], F.array_join(f"{c}.notes", "|").alias("notes")
    )


@query(
    "requested_commands",
    f"""with asked as (
      select t.*, p.* exclude (cargo_no, profile_cargo), [' Max_Cooling', 'ecomode', 'monitor', 'defrost', 'DECREASECOOLING'][event_id % 5 + 1] as requested,
       [ 'max_cooling', 'eco_mode', 'hold', null, 'decrease_cooling'][event_id % 5 + 1] as action
      from telemetry t join cargo_no p on t.cargo_type = p.profile_cargo),
    {command_sql('asked', 'action', 'r_')}
    select asset_id, event_id, requested, action is not null as success, action, case when action is not null then r_target end as target_temp,
     case when action is null then 'Unsupported action: ' || requested end as error from r_commanded""",
)
def requested_commands(t: Tables) -> DataFrame:
    """Commands asked for by hand in any spelling, some unsupported."""
    from ..operators.exposure import band, with_profile

    words = F.array(*[F.lit(w) for w in (" Max_Cooling", "ecomode", "monitor", "defrost", "DECREASECOOLING")])
    asked = band(with_profile(t.telemetry, t.profiles)).withColumn(
        "requested", F.element_at(words, (F.col("event_id") % 5 + 1).cast("int"))
    )
    return cooling.adjust(asked, "requested").select(
        "asset_id", "event_id", "requested", "command.success", "command.action", "command.target_temp", "command.error"
    )


DECIDED = f"""{SCORED}, {COOLING}, {command_sql('planned', 'recommended_action', 'p_')},
routed as (
 select p.*, b.target_dc, b.dc_name, b.eta_hours, b.distance_km, b.benefit_score
 from p_commanded p left join best b on p.asset_id = b.asset_id and p.prediction_id = b.prediction_id),
taken as (
 select *, case when risk_level = 'critical' and temperature_status = 'above_range' and lifted_action = 'hold' then 'max_cooling' else lifted_action end as action_taken,
  case when risk_level = 'moderate' then 'cooling_adjustment' when risk_level = 'critical' and refrigeration_failed then 'cooling_failure'
   when target_dc is not null then 'reroute' else 'cooling_adjustment' end as notify_type,
  case risk_level when 'moderate' then 'medium' else risk_level end as priority
 from (select *, case when risk_level = 'critical' and refrigeration_failed and recommended_action in ('hold', 'eco_mode') then 'emergency_mode'
   else recommended_action end as lifted_action from routed)),
listed_actions as (
 select *, unnest(list_filter([
   case when risk_level = 'low' then {{'kind': 'monitor', 'place': 0}} end,
   case when risk_level in ('high', 'critical') and target_dc is not null then {{'kind': 'reroute', 'place': 1}} end,
   case when risk_level <> 'low' then {{'kind': 'adjust_cooling', 'place': 2}} end,
   case when risk_level <> 'low' then {{'kind': 'notify', 'place': 3}} end,
   case when risk_level = 'critical' then {{'kind': 'escalate', 'place': 4}} end], lambda a: a is not null)) as a
 from taken),
action_rows as (
 select asset_id, prediction_id, cast(row_number() over (partition by asset_id, prediction_id order by a.place) - 1 as integer) as place, a.kind as type,
  case when a.kind = 'monitor' then 'low' when a.kind = 'escalate' then 'critical' else priority end as priority,
  case when a.kind = 'adjust_cooling' then action_taken end as action,
  case when a.kind = 'notify' then notify_type end as alert_type,
  case when a.kind = 'reroute' then target_dc end as target_dc,
  case a.kind when 'monitor' then 'Continue normal monitoring'
   when 'reroute' then 'Reroute to ' || dc_name || ' (ETA: ' || cast(eta_hours as varchar) || 'h)'
   when 'adjust_cooling' then 'Adjust refrigeration: ' || action_taken
   when 'escalate' then 'Escalate issue: Critical spoilage risk or refrigeration instability requires escalation'
   else case risk_level when 'moderate' then 'Alert logistics team of moderate spoilage risk'
    when 'high' then 'High-priority alert for logistics and quality teams' else 'Critical alert issued to operations leadership' end end as description
 from listed_actions)
"""

SEVERITY = """
graded as (
 select *, greatest(
  case when combined_score >= 0.95 then 4 when combined_score >= 0.85 then 3 when combined_score >= 0.40 then 2 else 1 end,
  case when time_to_failure_hours <= 1 then 4 when time_to_failure_hours <= 3 then 3 when time_to_failure_hours <= 6 then 2 else 1 end,
  case when refrigeration_failed or scenario = 'refrigeration_failure' then 3 else 1 end,
  case when door_open and combined_score >= 0.70 then 3 else 1 end,
  case when temperature >= 30 then 4 else 1 end,
  case when notify_type = 'reroute' then 1 when recommended_action = 'emergency_mode' then 4 when recommended_action = 'max_cooling' then 3
   when recommended_action = 'increase_cooling' then 2 else 1 end,
  case when notify_type <> 'reroute' then 1 when combined_score >= 0.70 or coalesce(time_to_failure_hours <= 3, false) then 3 else 2 end,
  case priority when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 1 end) as severity_no
 from taken where risk_level <> 'low'),
sent as (
 select asset_id, prediction_id, matched_ts, 0 as place, notify_type as alert_type, ['low', 'medium', 'high', 'critical'][severity_no] as severity,
  case risk_level when 'moderate' then 'Moderate spoilage risk detected' when 'high' then 'High spoilage risk requires immediate intervention'
   else 'Critical spoilage risk detected' end as reason,
  cargo_type, temperature, humidity, vibration, scenario, door_open, refrigeration_failed, risk_proxy, predicted_score, combined_score, time_to_failure_hours,
  case when notify_type <> 'reroute' then recommended_action end as told_action,
  case when notify_type <> 'reroute' then p_target end as target_temp, case when notify_type <> 'reroute' then p_power end as power,
  case when notify_type = 'reroute' then dc_name end as dc_name, case when notify_type = 'reroute' then eta_hours end as eta_hours,
  case when notify_type = 'reroute' then distance_km end as distance_km, case when notify_type = 'reroute' then benefit_score end as benefit_score,
  temp_degree_minutes
 from graded
 union all
 select asset_id, prediction_id, matched_ts, 1, 'escalation', 'critical', 'Critical spoilage risk or refrigeration instability requires escalation',
  cargo_type, temperature, humidity, vibration, scenario, door_open, refrigeration_failed, risk_proxy, predicted_score, combined_score, time_to_failure_hours,
  null, null, null, null, null, null, null, temp_degree_minutes
 from graded where risk_level = 'critical'),
alert_rows as (
 select *, row_number() over (order by matched_ts, asset_id, prediction_id, place) as alert_no,
  'Asset ' || asset_id || ' | cargo=' || cargo_type || ' | severity=' || severity || ' | alert_type=' || alert_type
  || ' | temperature=' || cast(temperature as varchar) || 'C | humidity=' || cast(humidity as varchar) || '% | vibration=' || cast(vibration as varchar)
  || 'g | scenario=' || scenario || ' | door_open=' || case when door_open then 'yes' else 'no' end
  || ' | refrigeration_failed=' || case when refrigeration_failed then 'yes' else 'no' end
  || ' | telemetry_risk_proxy=' || cast(risk_proxy as varchar) || ' | predicted_risk=' || cast(predicted_score as varchar)
  || ' | risk_score=' || cast(combined_score as varchar)
  || coalesce(' | time_to_failure_hours=' || cast(ROUNDED_HOURS as varchar), '') || ' | reason=' || reason || ' | decision=' || alert_type
  || coalesce(' | recommended_action=' || told_action, '') || coalesce(' | target_temp=' || cast(target_temp as varchar) || 'C', '')
  || coalesce(' | power_change_pct=' || cast(power as varchar), '') || coalesce(' | target_dc=' || dc_name, '')
  || coalesce(' | eta_hours=' || cast(eta_hours as varchar), '') || coalesce(' | distance_km=' || cast(distance_km as varchar), '')
  || coalesce(' | benefit_score=' || cast(benefit_score as varchar), '') || ' | temp_degree_minutes=' || cast(temp_degree_minutes as varchar) as message,
  case alert_type when 'reroute' then 'Reroute Recommendation' when 'cooling_adjustment' then 'Cooling Adjustment Alert'
   when 'cooling_failure' then 'Cooling Failure Alert' else 'Escalation Required' end as label,
  case when alert_type = 'escalation' then ['senior_logistics_manager', 'operations_director', 'quality_director'] else
   list_concat(case severity when 'low' then ['logistics_manager'] when 'medium' then ['logistics_manager', 'quality_officer']
     when 'high' then ['logistics_manager', 'quality_officer', 'fleet_supervisor']
     else ['logistics_manager', 'quality_officer', 'fleet_supervisor', 'operations_director'] end,
    list_filter(case alert_type when 'reroute' then ['logistics_manager', 'fleet_supervisor'] when 'cooling_adjustment' then ['fleet_supervisor', 'maintenance_team']
     else ['maintenance_team', 'operations_director', 'quality_officer'] end, lambda r: not list_contains(
     case severity when 'low' then ['logistics_manager'] when 'medium' then ['logistics_manager', 'quality_officer']
      when 'high' then ['logistics_manager', 'quality_officer', 'fleet_supervisor']
      else ['logistics_manager', 'quality_officer', 'fleet_supervisor', 'operations_director'] end, r))) end as people
 from sent)
""".replace("ROUNDED_HOURS", rounded("time_to_failure_hours", 2))

ALERTS = f"{DECIDED}, {SEVERITY}"


def planned_cases(t: Tables, numbered: bool = False) -> DataFrame:
    """Analysed cases with their reroute offers and cooling plan, and with the numbers of their decisions if wanted.

    The offers are computed once here; the actions read them many times.
    """
    return cooling.plan(decisions.with_reroute(case_table(t, numbered), t.centre))


def decided(t: Tables, numbered: bool = False) -> DataFrame:
    return decisions.decide(planned_cases(t, numbered))


def executed(t: Tables) -> DataFrame:
    """Decided cases with what came of their actions. They are numbered before, so their texts and results are made once and not moved."""
    return decisions.execute(decided(t, numbered=True))


def decision_table(t: Tables) -> DataFrame:
    """Records of all decisions; what reads them in many places reads what is written here."""
    return decisions.records(materialise(executed(t), "executed"))


def alert_table(t: Tables, documents: tuple[str, ...] = ()) -> DataFrame:
    """Alerts of all decisions; numbering counts them first, so their texts are written before.

    ``documents`` of the decision go along as the alert's metadata.
    """
    needed = decisions.records(executed(t)).select("ts", "decision_no", "decision_id", "notification", "escalation", *documents)
    return decisions.alert_records(materialise(needed, "decided"))


@query(
    "decision_actions",
    f"with {DECIDED} select asset_id, prediction_id, place, type, priority, action, alert_type, target_dc, description from action_rows",
)
def decision_actions(t: Tables) -> DataFrame:
    listed = decided(t).select("asset_id", "prediction_id", F.posexplode("actions").alias("place", "a"))
    return listed.select(
        "asset_id", "prediction_id", "place", "a.type", "a.priority", "a.action", "a.alert_type", "a.target_dc", "a.description"
    )


@query(
    "action_counts",
    f"""with {DECIDED} select t.risk_level, a.type, a.action, count(*) as actions
    from action_rows a join taken t on a.asset_id = t.asset_id and a.prediction_id = t.prediction_id group by all""",
)
def action_counts(t: Tables) -> DataFrame:
    listed = decided(t).select("risk_level", F.explode("actions").alias("a"))
    return listed.groupBy("risk_level", F.col("a.type").alias("type"), F.col("a.action").alias("action")).agg(
        F.count("*").alias("actions")
    )


@query(
    "decision_records",
    f"""with {DECIDED} select 'DECISION_' || lpad(cast(decision_no as varchar), 6, '0') as decision_id, asset_id, prediction_id, event_id, risk_level,
    notify_type, action_taken, target_dc, target_temp, matched_ts as ts, matched_ts as engine_timestamp, 'coldchain' as mqtt_prefix,
    temp_degree_minutes, out_of_range_minutes_in_hour from (
     select asset_id, prediction_id, event_id, matched_ts, risk_level, temp_degree_minutes, out_of_range_minutes_in_hour, case when risk_level <> 'low' then notify_type end as notify_type,
      case when risk_level <> 'low' then action_taken end as action_taken, target_dc,
      case when risk_level <> 'low' then {rounded('''case when freeze_sensitive and clamped <= freeze_c then greatest(freeze_c + 0.5, hard_low) else clamped end''', 2)} end as target_temp,
      row_number() over (order by matched_ts, asset_id, prediction_id) as decision_no
     from (select *, greatest(hard_low, least(hard_high, temperature + case action_taken when 'increase_cooling' then -2.0 when 'decrease_cooling' then 1.0
       when 'max_cooling' then -5.0 when 'eco_mode' then 0.5 when 'emergency_mode' then -8.0 else 0.0 end)) as clamped from taken))""",
)
def decision_records(t: Tables) -> DataFrame:
    def of(kind: str, field: str, part: str):
        first = F.get(F.filter("execution_results", lambda r: r["action"]["type"] == kind), F.lit(0))
        return first[part][field]

    return decision_table(t).select(
        "decision_id", "asset_id", "prediction.prediction_id", "telemetry.event_id", "analysis.risk_level",
        of("notify", "alert_type", "action").alias("notify_type"),
        of("adjust_cooling", "action", "action").alias("action_taken"),
        of("reroute", "target_dc", "result").alias("target_dc"),
        of("adjust_cooling", "target_temp", "result").alias("target_temp"),
        "ts", "engine_metadata.engine_timestamp", "engine_metadata.mqtt_prefix",
        "analysis.exposure_summary.temp_degree_minutes", "analysis.exposure_summary.out_of_range_minutes_in_hour",
    )


ALERT_FIELDS = "'ALERT_' || lpad(cast(alert_no as varchar), 6, '0') as alert_id, matched_ts as ts, asset_id, alert_type, severity"


@query(
    "alert_records",
    f"""with {ALERTS} select {ALERT_FIELDS}, '[' || upper(severity) || '] ' || label || ' - ' || asset_id as title, message,
    array_to_string(people, '|') as recipients, cast(len(people) as integer) as sent_to,
    case severity when 'low' then 'dashboard|audit_log' when 'medium' then 'dashboard|audit_log|email' when 'high' then 'dashboard|audit_log|email|sms'
     else 'dashboard|audit_log|email|sms|phone_call' end as channels, prediction_id from alert_rows""",
)
def alert_records(t: Tables) -> DataFrame:
    return alert_table(t, ("telemetry", "prediction")).select(
        "metadata.prediction.prediction_id", "alert_id", "ts", "asset_id", "alert_type", "severity", "title", "message",
        F.array_join("recipients", "|").alias("recipients"), "sent_to", F.array_join("channels", "|").alias("channels"),
    )


@query(
    "alert_severity",
    f"with {ALERTS} select alert_type, severity, count(*) as alerts from alert_rows group by all",
)
def alert_severity(t: Tables) -> DataFrame:
    return alert_table(t).groupBy("alert_type", "severity").agg(F.count("*").alias("alerts"))


@query("escalations", f"with {ALERTS} select {ALERT_FIELDS}, message from alert_rows where alert_type = 'escalation'")
def escalations(t: Tables) -> DataFrame:
    return alerts.history(alert_table(t), kind="escalation").select("alert_id", "ts", "asset_id", "alert_type", "severity", "message")


@query("alert_history", f"with {ALERTS} select {ALERT_FIELDS} from alert_rows where severity = 'critical'")
def alert_history(t: Tables) -> DataFrame:
    return alerts.history(alert_table(t), severity_word=" Severe").select("alert_id", "ts", "asset_id", "alert_type", "severity")


@query(
    "alert_summary",
    f"""with {ALERTS}, typed as (
      select asset_id, string_agg(alert_type || '=' || n, '|' order by alert_type) as types
      from (select asset_id, alert_type, count(*) as n from alert_rows group by all) group by asset_id)
    select a.asset_id, count(*) as total_notifications, count(*) filter (where severity = 'low') as low,
     count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'high') as high,
     count(*) filter (where severity = 'critical') as critical, any_value(types) as types,
     'ALERT_' || lpad(cast(max(alert_no) as varchar), 6, '0') as latest_alert
    from alert_rows a join typed t on a.asset_id = t.asset_id group by a.asset_id""",
)
def alert_summary(t: Tables) -> DataFrame:
    types = F.array_join(
        F.transform(F.array_sort(F.map_entries("alert_type_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|"
    )
    return alerts.summary(alert_table(t), ["ts", "alert_no"]).select(
        "asset_id", "total_notifications", *alerts.SEVERITIES, types.alias("types"), F.col("latest.alert_id").alias("latest_alert")
    )
