"""Messages, normalised documents, multi-way correlation and dashboard views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators import asof, dashboard, latest
from ..operators.asof import distinct_readings
from ..sources import messages as msg
from .cases import DECISION_MATCH, MATCHED, PREDICTION_WAIT, TELEMETRY_AGE, match
from .decide import DECIDED, decision_table
from .fleet import LATEST, RISK, SUMMARY
from .registry import query, rounded
from .tables import Tables


def topic_messages(t: Tables) -> DataFrame:
    """One message per event: canonical, alias spelling, id in the topic only, broken text or a list."""
    e = t.telemetry.join(t.events.select("event_id", "event_type"), "event_id")
    number = F.format_string("%.1f", "temperature")
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    exposure = '"cumulative_exposure":{"temp_degree_minutes":%s,"dooropenminutes":"2.5"}'
    canonical = F.format_string(
        '{"asset_id":"%s","timestamp":"%s","temperature":%s,"humidity":%s,"vibration":%s,"door_open":%s,"cargo_type":" %s ",'
        '"scenario":"%s","risk_proxy":%s,' + exposure + "}",
        "asset_id", day, number, F.col("humidity").cast("string"), F.col("vibration").cast("string"),
        F.col("door_open").cast("string"), F.upper("cargo_type"), "scenario", F.col("risk_proxy").cast("string"), F.col("vibration").cast("string"),
    )
    alias = F.format_string(
        '{"assetid":" %s ","ts":"%s","currenttemp":"%s","currenthumidity":"n/a","dooropen":" Yes ","cargotype":"%s","riskproxy":7,"refrigerationfailed":"on"}',
        "asset_id", day, number, "cargo_type",
    )
    bare = F.format_string('{"asset_id":"all","timestamp":"%s","temp":%s}', day, number)
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", canonical).when(kind == "view", alias).when(kind == "purchase", bare)
        .when(kind == "error", F.concat(F.lit("{broken "), number)).otherwise(F.concat(F.lit("["), number, F.lit("]")))
    )
    return e.select(F.concat(F.lit("coldchain/telemetry/"), "asset_id").alias("topic"), value.alias("value"))


@query(
    "message_routing",
    """select asset_id, case event_type when 'error' then 'quarantine' when 'signup' then 'quarantine' else 'telemetry' end as kind, count(*) as messages
    from telemetry join events using (event_id) group by all""",
)
def message_routing(t: Tables) -> DataFrame:
    decoded = msg.decode(topic_messages(t))
    good = msg.identified(msg.route(decoded)).select("asset_id", "kind")
    bad = msg.quarantine(decoded).select(
        F.element_at(F.split("topic", "/"), -1).alias("asset_id"), F.lit("quarantine").alias("kind")
    )
    return good.unionByName(bad).groupBy("asset_id", "kind").agg(F.count("*").alias("messages"))


@query(
    "normalize_telemetry",
    """select t.asset_id, t.ts, temperature, case event_type when 'click' then humidity else 0.0 end as humidity,
     case event_type when 'click' then vibration else 0.0 end as vibration,
     case event_type when 'click' then door_open when 'view' then true else false end as door_open,
     case event_type when 'purchase' then 'unknown' else cargo_type end as cargo_type,
     case event_type when 'click' then scenario else 'unknown' end as scenario, event_type = 'view' as refrigeration_failed,
     case event_type when 'click' then risk_proxy when 'view' then 1.0 else 0.0 end as risk_proxy,
     case event_type when 'click' then vibration else 0.0 end as temp_degree_minutes,
     cast(case event_type when 'click' then 2.5 else 0.0 end as double) as door_open_minutes
    from telemetry t join events e using (event_id) where event_type in ('click', 'view', 'purchase')""",
)
def normalize_telemetry(t: Tables) -> DataFrame:
    rows = msg.normalise_telemetry(msg.readings(topic_messages(t)))
    return rows.select(
        "asset_id", "ts", "temperature", "humidity", "vibration", "door_open", "cargo_type", "scenario", "refrigeration_failed",
        "risk_proxy", "cumulative_exposure.temp_degree_minutes", "cumulative_exposure.door_open_minutes",
    )


@query(
    "normalize_prediction",
    f"""select asset_id, ts, case when prediction_id % 4 = 2 then 0.0 else predicted_risk_proxy end as predicted_risk_proxy,
     case when prediction_id % 4 = 2 then predicted_risk_proxy else 0.0 end as actual_risk_proxy,
     predicted_risk_proxy as risk_score, case when prediction_id % 4 = 1 then null else time_to_failure_hours end as time_to_failure_hours from prediction""",
)
def normalize_prediction(t: Tables) -> DataFrame:
    """Prediction documents in four spellings: canonical, negative hours, actual risk only, joined names."""
    p = t.prediction
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    risk, hours = F.col("predicted_risk_proxy").cast("string"), F.coalesce(F.col("time_to_failure_hours").cast("string"), F.lit("null"))
    forms = [
        F.format_string('{"timestamp":"%s","predicted_risk_proxy":%s,"time_to_failure_hours":%s}', day, risk, hours),
        F.format_string('{"ts":"%s","riskscore":"%s","timetofailure":-1}', day, risk),
        F.format_string('{"timestamp":"%s","predicted_risk_proxy":0,"actual_risk_proxy":%s,"eta_to_failure_hours":%s}', day, risk, hours),
        F.format_string('{"timestamp":"%s","predictedriskproxy":%s,"timetofailurehours":%s}', day, risk, hours),
    ]
    which = F.col("prediction_id") % 4
    value = F.when(which == 0, forms[0]).when(which == 1, forms[1]).when(which == 2, forms[2]).otherwise(forms[3])
    sent = p.select(F.concat(F.lit("coldchain/predictions/"), "asset_id").alias("topic"), value.alias("value"))
    rows = msg.normalise_prediction(msg.identified(msg.route(msg.decode(sent))))
    return rows.select("asset_id", "ts", "predicted_risk_proxy", "actual_risk_proxy", "risk_score", "time_to_failure_hours")


def snapshot_messages(t: Tables) -> DataFrame:
    return msg.fleet_messages(t.telemetry.drop("gps_lat", "gps_lon"), F.date_trunc("day", "ts"), most=200)


@query(
    "fleet_snapshot",
    """select asset_id, ts, temperature, humidity, vibration, door_open, cargo_type, scenario, refrigeration_failed from telemetry""",
)
def fleet_snapshot(t: Tables) -> DataFrame:
    """Fleet messages of every day, unpacked again into readings."""
    back = msg.normalise_telemetry(msg.readings(snapshot_messages(t)))
    return back.select("asset_id", "ts", "temperature", "humidity", "vibration", "door_open", "cargo_type", "scenario", "refrigeration_failed")


@query(
    "dedupe_predictions",
    """select asset_id, ts, prediction_id from (
     select *, row_number() over (partition by asset_id, ts order by prediction_id) as rn from prediction) where rn = 1""",
)
def dedupe_predictions(t: Tables) -> DataFrame:
    """Predictions published twice, processed once per asset and timestamp."""
    sent = t.prediction.select("asset_id", "ts", "prediction_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return latest.changed(sent, "asset_id", "ts", ["ts", "prediction_id", "copy"]).drop("copy")


@query(
    "distinct_readings",
    "select asset_id, ts, event_id from telemetry",
)
def distinct_twice(t: Tables) -> DataFrame:
    """Readings that arrive singly and again in the fleet message, kept once."""
    sent = t.telemetry.select("asset_id", "ts", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return distinct_readings(sent, ["asset_id", "ts"], ["event_id", "copy"]).drop("copy")


EXPLAIN_AGE = 1800

THREE_WAY = f"""{DECISION_MATCH}, decided_at as (select asset_id, prediction_id as decision_no, matched_ts as decision_ts from matched),
{MATCHED.format(age=EXPLAIN_AGE, wait=EXPLAIN_AGE).replace('followed', 'followed2').replace('paired', 'paired2').replace('matched as', 'explained as')}"""


def decided_at(t: Tables) -> DataFrame:
    return match(t).select("asset_id", F.col("prediction_id").alias("decision_no"), F.col("matched_ts").alias("decision_ts"), "event_id")


@query(
    "three_way_asof",
    f"""with {THREE_WAY}, numbered as (
      select *, row_number() over (partition by asset_id, decision_ts order by decision_no desc) as rn from decided_at)
    select e.asset_id, e.prediction_id, e.event_id, e.matched_ts,
     case when epoch_us(e.matched_ts) - epoch_us(d.decision_ts) <= {EXPLAIN_AGE} * 1000000 then d.decision_no end as decision_no
    from explained e asof left join (select * from numbered where rn = 1) d on e.asset_id = d.asset_id and e.matched_ts >= d.decision_ts""",
)
def three_way_asof(t: Tables) -> DataFrame:
    """Prediction and reading required, decision optional.

    One pass over readings and predictions gives each prediction's reading for the decision and for the explanation; both go
    on as one flow, in which the newest decision at an explanation's time is found.
    """
    readings = t.telemetry.select("asset_id", "event_id", "ts")
    flow = asof.flow_of(
        asof.tagged(t.prediction.select("asset_id", "prediction_id", "ts"), asof.LEFT, "asset_id", order="prediction_id"),
        asof.tagged(readings, asof.RIGHT, "asset_id", order="event_id"),
    )
    rows = asof.with_neighbours(flow, max(TELEMETRY_AGE, PREDICTION_WAIT, EXPLAIN_AGE), [asof.RIGHT], True, asof.LEFT).filter(F.col("_kind") == asof.LEFT)

    def one(kind: int, matched: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("_kind"), F.greatest(F.col("_ts"), matched["ts"]).alias("_ts"), matched["event_id"].alias("event_id"), F.col("_order").alias("_order"),
        )

    decided, explained = asof.met(TELEMETRY_AGE, PREDICTION_WAIT)[0], asof.met(EXPLAIN_AGE, EXPLAIN_AGE)[0]
    found = rows.select("_key", F.explode(F.array(one(asof.RIGHT, decided), one(asof.LEFT, explained))).alias("m")).select("_key", "m.*").filter("event_id is not null")
    row = lambda kind, *columns: F.when(F.col("_kind") == kind, F.struct(*columns)).alias(f"row{kind}")
    both = found.select("_key", "_ts", "_order", "_kind", row(asof.RIGHT, F.col("_order").alias("decision_no")), row(asof.LEFT, "event_id"))
    pairs = asof.with_neighbours(both, EXPLAIN_AGE, [asof.RIGHT]).filter(F.col("_kind") == asof.LEFT)
    return pairs.select(
        F.col("_key").alias("asset_id"), F.col("_order").alias("prediction_id"), f"row{asof.LEFT}.event_id", F.col("_ts").alias("matched_ts"),
        asof.met(EXPLAIN_AGE, None)[0]["decision_no"].alias("decision_no"),
    )


LATE = "(decision_no * 53) % 3600"


@query(
    "decision_enrichment",
    f"""with {DECISION_MATCH}, late as (
      select asset_id, prediction_id as decision_no, event_id as own_reading, matched_ts + ({LATE.replace('decision_no', 'prediction_id')}) * interval '1' second as decision_ts from matched),
    newest as (select *, row_number() over (partition by asset_id, ts order by prediction_id desc) as rn from prediction)
    select l.asset_id, l.decision_no, l.decision_ts,
     case when epoch_us(l.decision_ts) - epoch_us(t.ts) <= {EXPLAIN_AGE} * 1000000 then t.event_id else l.own_reading end as event_id,
     case when epoch_us(l.decision_ts) - epoch_us(p.ts) <= {EXPLAIN_AGE} * 1000000 then p.prediction_id else l.decision_no end as prediction_id,
     coalesce(epoch_us(l.decision_ts) - epoch_us(t.ts) <= {EXPLAIN_AGE} * 1000000, false) as cached_reading
    from late l asof left join telemetry t on l.asset_id = t.asset_id and l.decision_ts >= t.ts
    asof left join (select * from newest where rn = 1) p on l.asset_id = p.asset_id and l.decision_ts >= p.ts""",
)
def decision_enrichment(t: Tables) -> DataFrame:
    """Decisions that arrive late, with the reading and prediction still cached, else those they carry."""
    delay = F.expr(f"{LATE} * interval '1' second")
    late = decided_at(t).select(
        "asset_id", "decision_no", F.col("event_id").alias("own_reading"), (F.col("decision_ts") + delay).alias("decision_ts")
    )
    decision, prediction, reading = 2, 1, 0
    flow = asof.flow_of(
        asof.tagged(t.telemetry.select("asset_id", "event_id", "ts"), reading, "asset_id", order="event_id"),
        asof.tagged(t.prediction.select("asset_id", "prediction_id", "ts"), prediction, "asset_id", order="prediction_id"),
        asof.tagged(late, decision, "asset_id", "decision_ts", "decision_no"),
    )
    rows = asof.with_neighbours(flow, EXPLAIN_AGE, [reading, prediction]).filter(F.col("_kind") == decision)
    cached, known = asof.met(EXPLAIN_AGE, None, reading)[0], asof.met(EXPLAIN_AGE, None, prediction)[0]
    return rows.select(
        f"row{decision}.asset_id", f"row{decision}.decision_no", f"row{decision}.decision_ts",
        F.coalesce(cached["event_id"], F.col(f"row{decision}.own_reading")).alias("event_id"),
        F.coalesce(known["prediction_id"], F.col(f"row{decision}.decision_no")).alias("prediction_id"),
        cached["event_id"].isNotNull().alias("cached_reading"),
    ).filter(F.col("event_id").isNotNull())


@query(
    "live_dashboard",
    f"""with {DECIDED}, {LATEST}, {RISK.format(source='latest')}, shown as ({SUMMARY}),
    last_prediction as (select * from prediction qualify row_number() over (partition by asset_id order by ts desc, prediction_id desc) = 1),
    last_decision as (select * from taken qualify row_number() over (partition by asset_id order by matched_ts desc, prediction_id desc) = 1)
    select s.asset_id, s.ts, s.risk_score, s.risk_level, s.summary, p.ts as prediction_ts, p.predicted_risk_proxy as predicted_risk,
     p.time_to_failure_hours, d.matched_ts as decision_ts, d.risk_level as decision_level, coalesce(b.alternatives, '') as nearest_centres
    from shown s left join last_prediction p on s.asset_id = p.asset_id left join last_decision d on s.asset_id = d.asset_id
    left join best b on d.asset_id = b.asset_id and d.prediction_id = b.prediction_id""",
)
def live_dashboard(t: Tables) -> DataFrame:
    decisions = decision_table(t).select(
        "asset_id", "ts", "decision_id", F.col("analysis.risk_level").alias("decision_level"), dashboard.centre_view().alias("centres")
    )
    view = dashboard.live_dashboard(t.telemetry, t.prediction, decisions)
    return view.select(
        "asset_id", "ts", "risk_score", "risk_level", "summary", "prediction_ts", "predicted_risk", "time_to_failure_hours",
        "decision_ts", "decision_level", F.coalesce(F.array_join(F.transform("centres", lambda c: c["id"]), "|"), F.lit("")).alias("nearest_centres"),
    )


@query(
    "prediction_view",
    f"""with assets as (select distinct asset_id from telemetry union select 'TRUCK_WITHOUT_DATA'),
    last_prediction as (select * from prediction qualify row_number() over (partition by asset_id order by ts desc, prediction_id desc) = 1)
    select a.asset_id, p.predicted_risk_proxy as predicted_risk, p.time_to_failure_hours, p.ts,
     case when p.asset_id is null then '{dashboard.NO_PREDICTION}' end as message,
     case when p.asset_id is null then 'NOT AVAILABLE' when p.predicted_risk_proxy >= 0.5 then 'HIGH' else 'LOW' end as label
    from assets a left join last_prediction p on a.asset_id = p.asset_id""",
)
def prediction_view(t: Tables) -> DataFrame:
    extra = t.spark.sql("select 'TRUCK_WITHOUT_DATA' as asset_id")
    assets = t.telemetry.select("asset_id").distinct().unionByName(extra)
    return dashboard.prediction_view(assets, t.prediction).withColumn("label", dashboard.predicted_label())


@query(
    "gauges",
    f"""with {LATEST} select asset_id, {rounded('(temperature - -30.0) / 60.0 * 100.0', 4)} as temperature_percent,
    {rounded('(humidity - 0.0) / 100.0 * 100.0', 4)} as humidity_percent, {rounded('(vibration - 0.0) / 10.0 * 100.0', 4)} as vibration_percent from latest""",
)
def gauges(t: Tables) -> DataFrame:
    shown = latest.latest_by(t.telemetry, ["asset_id"], ["ts", "event_id"])
    return shown.select(
        "asset_id",
        round_to(dashboard.gauge_percent("temperature", -30.0, 30.0), 4).alias("temperature_percent"),
        round_to(dashboard.gauge_percent("humidity", 0.0, 100.0), 4).alias("humidity_percent"),
        round_to(dashboard.gauge_percent("vibration", 0.0, 10.0), 4).alias("vibration_percent"),
    )


@query(
    "reading_risk_join",
    f"""with {RISK.format(source='telemetry')} select t.asset_id, t.ts, t.temperature, cast(r.risk_score as integer) as risk_score, r.risk_level
    from telemetry t join risk r on t.asset_id = r.asset_id and t.ts = r.ts""",
)
def reading_risk_join(t: Tables) -> DataFrame:
    """Risk of exactly the reading shown, joined by asset and timestamp."""
    from ..operators.risk import threshold_risk

    scored = threshold_risk(t.telemetry).select("asset_id", "ts", "risk_score", "risk_level")
    return latest.at_reading(t.telemetry.select("asset_id", "ts", "temperature"), scored)


def _bare(expr: str) -> str:
    return f"regexp_replace(cast({expr} as varchar), '\\.0$', '')"


@query(
    "room_alerts",
    f"""with joined as (select * from room_reading join rooms using (room_id)),
    raised as (
     select event_id, room_id, room_name, ts, unnest(list_filter([
      case when temperature < temp_min then {{'type': 'Temperature Too Low', 'severity': 'warning',
        'message': 'Temperature is ' || {_bare('temperature')} || '°C (Required: ' || {_bare('temp_min')} || '°C – ' || {_bare('temp_max')} || '°C)'}}
       when temperature > temp_max then {{'type': 'Temperature Too High', 'severity': 'critical',
        'message': 'Temperature is ' || {_bare('temperature')} || '°C (Required: ' || {_bare('temp_min')} || '°C – ' || {_bare('temp_max')} || '°C)'}} end,
      case when humidity < hum_min then {{'type': 'Humidity Too Low', 'severity': 'warning',
        'message': 'Humidity is ' || {_bare('humidity')} || '% (Required: ' || {_bare('hum_min')} || '% – ' || {_bare('hum_max')} || '%)'}}
       when humidity > hum_max then {{'type': 'Humidity Too High', 'severity': 'warning',
        'message': 'Humidity is ' || {_bare('humidity')} || '% (Required: ' || {_bare('hum_min')} || '% – ' || {_bare('hum_max')} || '%)'}} end,
      case when door_status = 'Open' then {{'type': 'Door Open', 'severity': 'critical', 'message': 'Storage door is currently open'}} end,
      case when power_status = 'Failed' then {{'type': 'Power Failure', 'severity': 'critical', 'message': 'Power supply to cooling system has failed'}} end
     ], lambda a: a is not null)) as a from joined)
    select event_id, room_id, room_name, ts, a.type as type, a.severity as severity, a.message as message from raised""",
)
def room_alerts(t: Tables) -> DataFrame:
    return dashboard.room_alerts(t.room_reading, t.rooms).select(
        "event_id", "room_id", "room_name", "ts", "type", "severity", "message"
    )
