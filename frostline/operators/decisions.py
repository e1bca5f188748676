"""Actions for a case, their results, and the decision and alert records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import plain, round_to
from ..functions.text import kept
from ..functions.values import blank_to_null, truth
from ..session import materialise
from ..sources.messages import PREFIX
from . import alerts, cooling, routing
from .exposure import EXPOSURE_FIELDS
from .running import numbered_rows, numbered_within

# Texts of the actions.
MONITOR_TEXT = "Continue normal monitoring"
NOTIFY_TEXTS = {
    "moderate": ("Alert logistics team of moderate spoilage risk", "Moderate spoilage risk detected"),
    "high": ("High-priority alert for logistics and quality teams", "High spoilage risk requires immediate intervention"),
    "critical": ("Critical alert issued to operations leadership", "Critical spoilage risk detected"),
}
ESCALATE_REASON = "Critical spoilage risk or refrigeration instability requires escalation"
PRIORITIES = {"moderate": "medium", "high": "high", "critical": "critical"}
REROUTE_RESULTS = {"high": 2, "critical": 3}
ENGINE_NAME = "decision_engine"

# Every action has all of these fields, null where the type does not use one.
ACTION_FIELDS = {
    "type": "string",
    "action": "string",
    "recommended_action": "string",
    "alert_type": "string",
    "description": "string",
    "priority": "string",
    "tool": "string",
    "asset_id": "string",
    "reason": "string",
    "risk_level": "string",
    "target_dc": "string",
    "dc_name": "string",
    "eta_hours": "double",
    "distance_km": "double",
    "benefit_score": "double",
    "reroute_recommended": "boolean",
    "cargo_type": "string",
    "current_temp": "double",
}


def action(**fields) -> Column:
    def value(name: str, kind: str) -> Column:
        given = fields.get(name)
        column = given if isinstance(given, Column) else F.lit(given)
        return column.cast(kind).alias(name)

    return F.struct(*[value(name, kind) for name, kind in ACTION_FIELDS.items()])


def with_reroute(cases: DataFrame, centres: DataFrame) -> DataFrame:
    """Add ``recommended_dc`` and ``alternatives`` to cases of high and critical level.

    Cases with offers are written once, for those who read the offers many times; the others are neither moved nor written.
    """
    urgent = F.coalesce(F.col("risk_level").isin(*REROUTE_RESULTS), F.lit(False)) & F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    results = F.when(F.col("risk_level") == "critical", REROUTE_RESULTS["critical"]).otherwise(REROUTE_RESULTS["high"])
    offered = routing.with_recommended(cases.filter(urgent), centres, results, most=max(REROUTE_RESULTS.values()))
    return materialise(offered, "rerouted").unionByName(cases.filter(~urgent), allowMissingColumns=True)


def decide(planned: DataFrame) -> DataFrame:
    """Add the action list of each case, by its level.

    Expects analysed cases with their cooling plan and reroute offers. A case
    of low level is only monitored, even if it asks for action.
    """
    level = F.col("risk_level")
    dc, asset = F.col("recommended_dc"), F.col("asset_id")
    rerouted = dc.isNotNull()
    failed = truth("refrigeration_failed")
    priority = cooling.lookup(PRIORITIES, level)
    chosen = F.col("recommended_action")
    critical = level == "critical"

    # In a critical case too little cooling is replaced; what was recommended stays on record.
    lifted = F.when(critical & failed & chosen.isin("hold", "eco_mode"), "emergency_mode").otherwise(chosen)
    taken = F.when(critical & (F.col("temperature_status") == "above_range") & (lifted == "hold"), "max_cooling").otherwise(lifted)
    kind = (
        F.when(level == "moderate", "cooling_adjustment")
        .when(critical & failed, "cooling_failure")
        .when(rerouted, "reroute")
        .otherwise("cooling_adjustment")
    )
    told = {name: cooling.lookup(NOTIFY_TEXTS, level, lambda e, i=i: e[i]) for i, name in enumerate(("text", "reason"))}
    planned = planned.withColumns({"action_taken": taken, "notify_type": kind, "notify_reason": told["reason"]})
    taken, kind = F.col("action_taken"), F.col("notify_type")
    acts = level != "low"
    urgent = level.isin(*REROUTE_RESULTS)
    return planned.withColumn(
        "actions",
        kept([
            F.when(~acts, action(
                type="monitor", description=MONITOR_TEXT, priority="low", tool="none", asset_id=asset, risk_level=level)),
            F.when(urgent & rerouted, action(
                type="reroute", priority=priority, tool="routing", asset_id=asset,
                description=F.concat(F.lit("Reroute to "), dc["name"], F.lit(" (ETA: "), plain(dc["eta_hours"], 2), F.lit("h)")),
                target_dc=dc["id"], dc_name=dc["name"], eta_hours=dc["eta_hours"], distance_km=dc["distance_km"],
                benefit_score=dc["benefit_score"], reroute_recommended=True)),
            F.when(acts, action(
                type="adjust_cooling", action=taken, recommended_action=chosen, priority=priority, tool="refrigeration",
                description=F.concat(F.lit("Adjust refrigeration: "), taken), asset_id=asset,
                cargo_type=F.col("cargo_type"), current_temp=F.col("temperature"))),
            F.when(acts, action(
                type="notify", alert_type=kind, description=told["text"], priority=priority, tool="notification",
                asset_id=asset, reason=F.col("notify_reason"))),
            F.when(critical, action(
                type="escalate", description=F.lit(f"Escalate issue: {ESCALATE_REASON}"), priority="critical",
                tool="notification", asset_id=asset, reason=ESCALATE_REASON)),
        ]),
    )


def execute(decided: DataFrame) -> DataFrame:
    """Carry out the actions: the cooling command taken and the alerts sent.

    A notification about rerouting repeats the chosen centre, one about cooling
    the recommended command of the same decision.
    """
    level, kind = F.col("risk_level"), F.col("notify_type")
    acts = level != "low"
    routes, cools = kind == "reroute", kind.isin("cooling_adjustment", "cooling_failure")
    asset = F.coalesce(blank_to_null("asset_id"), F.lit("UNKNOWN_ASSET"))
    told_action = F.when(cools, F.col("recommended_action"))
    command = F.when(cools, F.col("command_preview"))
    centre = F.when(routes, F.col("recommended_dc"))
    how_bad = alerts.inferred_severity(kind, cooling.lookup(PRIORITIES, level), told_action, routes & centre.isNotNull())
    run = cooling.adjust(decided, "action_taken", "command").withColumn("_severity", how_bad)
    how_bad = F.col("_severity")
    notice = alerts.message(asset, kind, how_bad, F.col("notify_reason"), kind, told_action, command, centre)
    escalation = F.lit("escalation")
    raised = alerts.message(
        asset, escalation, F.lit("critical"), F.lit(ESCALATE_REASON), escalation, F.lit(None).cast("string")
    )
    run = run.withColumns({"_notice": notice, "_raised": raised})
    people = F.array(*[F.lit(p) for p in alerts.TYPE_RECIPIENTS["escalation"]])
    return run.withColumns(
        {
            "command": F.when(acts, F.col("command")),
            "notification": F.when(acts, alerts.alert(asset, kind, how_bad, F.col("_notice"))),
            "escalation": F.when(
                level == "critical", alerts.alert(asset, escalation, F.lit("critical"), F.col("_raised"), people)
            ),
        }
    ).drop("_severity", "_notice", "_raised")


def execution_results() -> Column:
    """What came of each action, in the order of the actions."""
    def result(a: Column) -> Column:
        kind = a["type"]
        sent = F.when(kind == "notify", F.col("notification")).when(kind == "escalate", F.col("escalation"))
        known = kind.isin("monitor", "adjust_cooling", "reroute", "notify", "escalate")
        return F.struct(
            F.when(kind == "adjust_cooling", F.col("command.success")).otherwise(known).alias("success"),
            F.coalesce(kind, F.lit("unknown")).alias("type"),
            F.coalesce(a["asset_id"], F.lit("UNKNOWN_ASSET")).alias("asset_id"),
            F.when(kind == "monitor", "monitoring").when(kind == "reroute", "recommended")
            .otherwise(sent["status"]).alias("status"),
            F.when(kind == "monitor", a["description"]).otherwise(sent["message"]).alias("message"),
            F.when(kind == "adjust_cooling", F.col("command.target_temp")).alias("target_temp"),
            F.when(kind == "adjust_cooling", F.col("command.estimated_time_minutes")).alias("estimated_time_minutes"),
            a["target_dc"].alias("target_dc"),
            sent["severity"].alias("severity"),
            F.when(~known, F.concat(F.lit("Unknown action type: "), kind))
            .otherwise(F.when(kind == "adjust_cooling", F.col("command.error"))).alias("error"),
        )

    return F.transform("actions", lambda a: F.struct(a.alias("action"), result(a).alias("result")))


def numbered(prefix: str, position: Column) -> Column:
    digits = position.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


DECISION_ORDER = ["matched_ts", "asset_id", "prediction_id"]


def records(executed: DataFrame) -> DataFrame:
    """Decision records in the order the cases became complete; cases that have their ``decision_no`` keep it."""
    rows = executed if "decision_no" in executed.columns else numbered_rows(executed, DECISION_ORDER, "decision_no")
    return rows.select(
        "decision_no",
        numbered("DECISION_", F.col("decision_no")).alias("decision_id"),
        F.col("matched_ts").alias("ts"),
        "asset_id",
        F.struct(
            "event_id", F.col("ts").alias("ts"), "cargo_type", "scenario", "temperature", "humidity", "vibration", "door_open",
            "refrigeration_failed", "risk_proxy", "gps_lat", "gps_lon", "temp_degree_minutes", "humidity_percent_minutes",
            "door_open_minutes", "vibration_warn_minutes", "vibration_critical_minutes", "out_of_range_minutes_in_hour",
        ).alias("telemetry"),
        F.struct("prediction_id", F.col("prediction_ts").alias("ts"), "predicted_risk_proxy", "time_to_failure_hours").alias("prediction"),
        F.struct(
            "predicted_score", "telemetry_score", "risk_score", "risk_level", "contributing_factors", "time_to_failure_hours",
            "requires_action", "temperature_status", F.col("target_low").alias("min_c"), F.col("target_high").alias("max_c"),
            F.col("target_ideal").alias("ideal_c"),
            F.struct(*[round_to(c, 2).alias(c) for c in EXPOSURE_FIELDS]).alias("exposure_summary"),
        ).alias("analysis"),
        "actions",
        execution_results().alias("execution_results"),
        "recommended_dc",
        "alternatives",
        "notification",
        "escalation",
        F.struct(
            # The time the case became complete: a later run gives the same record.
            F.col("matched_ts").alias("engine_timestamp"), F.lit(ENGINE_NAME).alias("engine_name"), "asset_id",
            F.col("prediction_ts").alias("prediction_timestamp"), F.col("ts").alias("telemetry_timestamp"), F.lit(PREFIX).alias("mqtt_prefix"),
        ).alias("engine_metadata"),
    )


def alert_records(decisions: DataFrame) -> DataFrame:
    """Alerts of all decisions with running numbers, notification before escalation.

    Where the decisions have their reading and prediction, these are the alert's metadata.
    """
    documents = [c for c in ("telemetry", "prediction") if c in decisions.columns]
    metadata = [F.struct("decision_id", *documents).alias("metadata")] if documents else []
    sent = decisions.select(
        "ts", "decision_no", "decision_id", *metadata, F.posexplode(kept([F.col("notification"), F.col("escalation")])).alias("place", "alert")
    )
    return numbered_within(sent, "decision_no", ["place"], "alert_no").select(
        "alert_no", numbered("ALERT_", F.col("alert_no")).alias("alert_id"), "ts", "decision_id", "alert.*", *(["metadata"] if documents else [])
    )
