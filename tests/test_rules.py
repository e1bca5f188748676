"""Rules on their thresholds."""

import itertools

import pytest
from pyspark.sql import functions as F

from frostline.data import profiles
from frostline.operators import alerts, cooling, decisions, exposure, nearest, risk
from frostline.operators.explain import urgency


def one(spark, column, **fields):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "score, failed, hours, expected",
    [(0.39, False, None, "low"), (0.40, False, None, "moderate"), (0.75, False, None, "high"), (0.95, False, None, "critical"),
     (0.1, True, None, "moderate"), (0.5, True, None, "high"), (0.8, True, None, "high"), (0.1, False, 1.0, "critical"),
     (0.1, False, 3.0, "high"), (0.1, False, 3.1, "low"), (0.97, False, 3.0, "critical"), (0.1, False, 0.0, "critical")],
)
def test_risk_level(spark, score, failed, hours, expected):
    got = one(spark, risk.risk_level(F.col("s"), F.col("f"), F.col("h").cast("double")), s=score, f=failed, h=hours)
    assert got == expected


@pytest.mark.parametrize(
    "score, failed, door, hours, expected",
    [(0.39, False, False, None, "low"), (0.70, False, True, None, "high"), (0.69, False, True, None, "moderate"),
     (0.95, False, False, None, "critical"), (0.2, True, False, 2.0, "high"), (0.2, False, False, 0.5, "critical")],
)
def test_urgency(spark, score, failed, door, hours, expected):
    got = one(spark, urgency(F.col("s"), F.col("h").cast("double"), F.col("f"), F.col("d")), s=score, f=failed, d=door, h=hours)
    assert got == expected


def reading(**changes):
    base = dict(
        asset_id="T1", event_id=1, cargo_type="vaccines", scenario="normal", temperature=5.0, humidity=50.0, vibration=1.0,
        door_open=False, refrigeration_failed=False, risk_proxy=0.1, predicted_risk_proxy=0.1, time_to_failure_hours=None,
        temp_degree_minutes=0.0, humidity_percent_minutes=0.0, door_open_minutes=0.0, vibration_warn_minutes=0.0,
        vibration_critical_minutes=0.0, out_of_range_minutes_in_hour=0.0, prediction_id=1,
    )
    return {**base, **changes}


SCHEMA = (
    "asset_id string, event_id bigint, cargo_type string, scenario string, temperature double, humidity double, vibration double, "
    "door_open boolean, refrigeration_failed boolean, risk_proxy double, predicted_risk_proxy double, time_to_failure_hours double, "
    "temp_degree_minutes double, humidity_percent_minutes double, door_open_minutes double, vibration_warn_minutes double, "
    "vibration_critical_minutes double, out_of_range_minutes_in_hour double, prediction_id bigint"
)


def analysed(spark, *rows):
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    return risk.analyse(exposure.band(exposure.with_profile(df, profiles.cargo_profiles(spark))))


def test_unknown_cargo_uses_the_default_band(spark):
    rows = [reading(cargo_type=c, event_id=i) for i, c in enumerate([None, "rocks", " VACCINES ", ""])]
    got = analysed(spark, *rows).orderBy("event_id").select("target_low", "target_high", "profile_cargo").collect()
    assert [(r[0], r[1]) for r in got] == [(2.0, 8.0)] * 4
    assert [r[2] for r in got] == [None, None, "vaccines", None]


def test_factors_in_order(spark):
    row = reading(
        temperature=20.0, refrigeration_failed=True, scenario="refrigeration_failure", humidity=90.0, vibration=6.0, door_open=True,
        temp_degree_minutes=1.0, humidity_percent_minutes=1.0, door_open_minutes=1.0, vibration_warn_minutes=1.0,
        vibration_critical_minutes=1.0, out_of_range_minutes_in_hour=10.5, time_to_failure_hours=6.0,
    )
    calm = reading(event_id=2, scenario=None, out_of_range_minutes_in_hour=10.0, humidity=19.9)
    got = analysed(spark, row, calm).orderBy("event_id").select("contributing_factors", "requires_action").collect()
    assert got[0][0] == [
        "temperature_excursion", "refrigeration_failure", "refrigeration_failure_scenario", "high_humidity", "excessive_vibration",
        "door_open_event", "cumulative_temperature_exposure", "cumulative_humidity_exposure", "cumulative_door_open_exposure",
        "cumulative_vibration_exposure", "critical_vibration_exposure", "sustained_out_of_range_exposure", "short_time_to_failure",
    ]
    assert got[1][0] == ["low_humidity"]
    assert [r[1] for r in got] == [True, False]


def cooling_by_hand(cargo, t, risk_, failed, scenario):
    """The rules in plain words, written independently of the column expression."""
    limits = {p[0]: p for p in profiles.CARGO_PROFILES}.get(cargo)
    if limits is None:
        d = t - 5.0
        if (failed and (risk_ >= 0.4 or d > 1)) or risk_ >= 0.85:
            return "emergency_mode"
        if risk_ >= 0.65 or d >= 5:
            return "max_cooling"
        if risk_ >= 0.4 or d >= 2:
            return "increase_cooling"
        if d <= -1:
            return "decrease_cooling"
        return "eco_mode" if abs(d) <= 0.5 and risk_ < 0.2 else "hold"
    low, high, sensitive, freeze = limits[1], limits[2], limits[11], limits[12]
    if sensitive and t <= freeze:
        return "decrease_cooling"
    if (failed or scenario == "refrigeration_failure") and (t >= high or risk_ >= 0.4):
        return "emergency_mode"
    if (sensitive and t <= freeze + 0.5) or t < low - 1.5:
        return "decrease_cooling"
    return "eco_mode" if low <= t <= high and risk_ < 0.2 else "hold"


def test_cooling_rules(spark):
    grid = list(itertools.product(
        ["vaccines", "meat", "rocks"], [-3.0, 0.0, 0.3, 2.0, 4.0, 4.5, 5.4, 6.1, 7.0, 8.0, 10.0], [0.0, 0.2, 0.4, 0.65, 0.85], [True, False],
        ["normal", "refrigeration_failure"],
    ))
    rows = [
        reading(event_id=i, cargo_type=c, temperature=t, risk_proxy=r, predicted_risk_proxy=0.0, refrigeration_failed=f, scenario=s)
        for i, (c, t, r, f, s) in enumerate(grid)
    ]
    got = cooling.plan(analysed(spark, *rows)).orderBy("event_id").select("recommended_action").collect()
    assert [r[0] for r in got] == [cooling_by_hand(*g) for g in grid]


def test_command_protects_against_freezing_and_rejects_unknown_actions(spark):
    rows = [reading(event_id=1, temperature=1.0), reading(event_id=2, temperature=1.0)]
    df = analysed(spark, *rows).withColumn("asked", F.when(F.col("event_id") == 1, "MaxCooling").otherwise("defrost"))
    got = [r["command"] for r in cooling.adjust(df, "asked").orderBy("event_id").collect()]
    assert (got[0]["target_temp"], got[0]["action"], got[0]["estimated_time_minutes"]) == (0.5, "max_cooling", 7.5)
    assert "Freeze-sensitive cargo protection applied" in got[0]["notes"]
    assert (got[1]["success"], got[1]["error"]) == (False, "Unsupported action: defrost")


def test_severity_words(spark):
    words = ["urgent", " Moderate ", "nonsense", None, "EMERGENCY", "info"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert [r[0] for r in df.orderBy("i").select(alerts.severity("w")).collect()] == ["high", "medium", "medium", "medium", "critical", "low"]


def test_alert_type(spark):
    df = spark.createDataFrame(
        [(1, "route_change", False, False, False), (2, None, True, False, False), (3, None, False, True, True),
         (4, None, False, True, False), (5, "", False, False, True), (6, None, False, False, False)],
        "i int, kind string, route boolean, cool boolean, refrigeration_failed boolean",
    ).withColumns({"scenario": F.lit("normal"), "door_open": F.col("i") == 6})
    got = df.orderBy("i").select(alerts.alert_type(F.col("kind"), F.col("route"), F.col("cool"))).collect()
    assert [r[0] for r in got] == ["reroute", "reroute", "cooling_failure", "cooling_adjustment", "cooling_failure", "door_event"]


def test_given_recipients_replace_the_usual_ones(spark):
    got = one(spark, alerts.recipients(F.lit("reroute"), F.lit("low"), F.array(F.lit("a"), F.lit(" "))))
    usual = one(spark, alerts.recipients(F.lit("reroute"), F.lit("low")))
    assert (got, usual) == (["a"], ["logistics_manager", "fleet_supervisor"])


def test_severity_is_at_least_each_cause(spark):
    rows = [
        reading(event_id=i, risk_proxy=r, time_to_failure_hours=h, refrigeration_failed=f, temperature=t, door_open=d)
        for i, (r, h, f, t, d) in enumerate(itertools.product([0.1, 0.4, 0.7, 0.85, 0.95], [None, 1.0, 3.0, 6.0], [True, False], [5.0, 30.0], [True, False]))
    ]
    df = analysed(spark, *rows)
    none = F.lit(None).cast("string")
    level = alerts.severity_rank(alerts.inferred_severity(F.lit("spoilage_risk"), none, none, F.lit(False)))
    bad = df.withColumn("s", level).filter(
        ((F.col("combined_score") >= 0.95) & (F.col("s") < 4)) | ((F.col("time_to_failure_hours") <= 1) & (F.col("s") < 4))
        | (F.col("refrigeration_failed") & (F.col("s") < 3)) | ((F.col("temperature") >= 30) & (F.col("s") < 4))
        | ((F.col("combined_score") >= 0.40) & (F.col("s") < 2))
    )
    assert bad.count() == 0


def test_low_level_that_needs_action_is_only_monitored(spark):
    df = cooling.plan(analysed(spark, reading(temperature=9.0))).withColumns(
        {"recommended_dc": F.lit(None).cast("struct<id:string,name:string,eta_hours:double,distance_km:double,benefit_score:double>")})
    row = decisions.decide(df).select("requires_action", "actions").first()
    assert row["requires_action"] and [a["type"] for a in row["actions"]] == ["monitor"]


def test_vaccine_hard_limit_adds_nothing(spark):
    df = spark.createDataFrame([("vaccines", 50.0, 40.0, 0.1), (None, None, None, None), ("meat", 50.0, 61.0, 5.1)],
                               "cargo_type string, temperature double, humidity double, vibration double")
    assert [r["risk_score"] for r in risk.threshold_risk(df).collect()] == [30, 0, 70]


def test_travel_speed(spark):
    rows = [("normal", False, 45.0), ("micro_excursions", True, 40.0), ("refrigeration_failure", False, 40.0), ("else", False, 60.0)]
    df = spark.createDataFrame(rows, "s string, f boolean, e double")
    got = df.select(nearest.travel_speed(F.col("s"), F.col("f"), 60.0), "e").collect()
    assert all(r[0] == r[1] for r in got)
