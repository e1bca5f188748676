"""Messages, files, stored tables and the guidance corpus."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from frostline.data import profiles
from frostline.operators import alerts, explain
from frostline.schemas import MESSAGE
from frostline.sources import guidance, tables, training
from frostline.sources import messages as msg


def sent(spark, *rows):
    return spark.createDataFrame([(t, v if isinstance(v, str) else json.dumps(v)) for t, v in rows], MESSAGE)


def test_routing_ids_and_quarantine(spark):
    df = sent(
        spark,
        ("coldchain/telemetry/T1", {"asset_id": "A1", "temperature": 3}),
        ("coldchain/telemetry/T2", {"temperature": 3}),
        ("coldchain/telemetry/T3", "[1, 2]"),
        ("coldchain/telemetry/T4", "{broken"),
        ("coldchain/telemetry/all", {"batch": [{"asset_id": "B1"}, 5, None, {"no": "id"}, {"assetid": "B2", "temp": 4}, "x"]}),
        ("coldchain/telemetry/all", {"batch": "none"}),
        ("coldchain/telemetry/ALL", {"assetid": "all"}),
        ("coldchain/predictions/T5", {"asset_id": " "}),
        ("coldchain/decisions/T6", {}),
        ("other/telemetry/T7", {"asset_id": "A7"}),
    )
    decoded = msg.decode(df)
    assert {r["topic"] for r in msg.quarantine(decoded).collect()} == {"coldchain/telemetry/T3", "coldchain/telemetry/T4"}
    assert sorted(r["asset_id"] for r in msg.readings(df).collect()) == ["A1", "B1", "B2", "T2"]
    kinds = {r["topic"]: r["kind"] for r in msg.route(decoded).collect()}
    assert kinds["coldchain/predictions/T5"] == "prediction" and kinds["coldchain/decisions/T6"] == "decision"
    assert "other/telemetry/T7" not in kinds
    ids = msg.identified(msg.route(decoded)).filter("kind = 'prediction'").collect()
    assert [r["asset_id"] for r in ids] == ["T5"]


def test_topic_patterns_are_no_ids(spark):
    df = sent(spark, ("a/#", {}), ("a/T1", {}), ("T2", {}))
    strict = msg.decode(df).select("topic", msg.asset_id().alias("i"), msg.asset_id(least_parts=1, reject="#+").alias("loose")).collect()
    assert [(r["i"], r["loose"]) for r in strict] == [(None, None), (None, "T1"), (None, "T2")]


def test_normalised_documents(spark):
    telemetry = msg.normalise_telemetry(msg.decode(sent(spark, (
        "x", {"assetid": "A", "ts": "2024-01-02T03:04:05Z", "temp": "4.5", "latitude": 1, "dooropen": "ON", "cargo_type": " Meat ",
              "telemetryriskproxy": 3, "cumulative_exposure": {"temp_degree_minutes": "7"}})))).first()
    assert (telemetry["asset_id"], telemetry["temperature"], telemetry["gps_lat"], telemetry["door_open"]) == ("A", 4.5, 1.0, True)
    assert (telemetry["cargo_type"], telemetry["scenario"], telemetry["risk_proxy"]) == ("meat", "unknown", 1.0)
    assert telemetry["cumulative_exposure"]["temp_degree_minutes"] == 7.0 and telemetry["ts"].hour == 3
    prediction = msg.normalise_prediction(msg.decode(sent(spark, ("x", {"riskscore": "bad", "actualriskproxy": 0.7, "etatofailurehours": 0})))).first()
    assert (prediction["asset_id"], prediction["predicted_risk_proxy"], prediction["risk_score"], prediction["time_to_failure_hours"]) == (
        "UNKNOWNASSET", 0.0, 0.7, 0.0)


def test_normalised_decision(spark):
    doc = {
        "decision_id": "D1", "asset_id": "A", "time_to_failure_hours": 5, "analysis": {
            "risk_score": 0.8, "risk_level": "HIGH", "contributing_factors": [" a ", "", "b"], "time_to_failure_hours": 0, "requires_action": True},
        "actions": [{"type": "Reroute", "target_dc": "DC1", "eta_hours": "2.5"}, "noise", 7, {"description": "x"}],
    }
    got = msg.normalise_decision(msg.decode(sent(spark, ("x", doc)))).first()
    assert (got["risk_level"], got["contributing_factors"], got["time_to_failure_hours"], got["requires_action"]) == ("high", ["a", "b"], 5.0, True)
    assert [(a["type"], a["priority"], a["target_dc"], a["eta_hours"]) for a in got["actions"]] == [
        ("reroute", "medium", "DC1", 2.5), ("unknown", "medium", "", 0.0)]
    empty = msg.normalise_decision(msg.decode(sent(spark, ("x", {"actions": "no", "analysis": 3})))).first()
    assert (empty["actions"], empty["contributing_factors"], empty["risk_score"]) == ([], [], 0.0)


def test_asset_of_three_inputs(spark):
    df = spark.createDataFrame([("UNKNOWNASSET", "P", "D"), ("", "UNKNOWNASSET", "D"), ("UNKNOWNASSET", "", "UNKNOWNASSET")], "t string, p string, d string")
    assert [r[0] for r in df.select(msg.merged_asset("t", "p", "d")).collect()] == ["P", "D", "UNKNOWNASSET"]


def test_missing_prediction_fields_are_completed(spark):
    df = spark.createDataFrame([("0.4", "3")], "riskscore string, timetofailure string")
    got = msg.complete_prediction(df).first()
    assert (got["risk_score"], got["predicted_risk_proxy"], got["time_to_failure_hours"]) == (0.4, 0.4, 3.0)


def test_fleet_messages_of_a_large_tick_are_split_and_complete(spark):
    df = spark.range(1000).select(F.concat(F.lit("T"), "id").alias("asset_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), (F.col("id") / 10).alias("temperature"))
    out = msg.fleet_messages(df, F.col("ts"), most=100)
    assert out.count() == 10
    back = msg.normalise_telemetry(msg.readings(out))
    assert back.count() == 1000 and back.select("asset_id").distinct().count() == 1000


def test_training_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text(
        "asset_id,timestamp,risk_proxy,door_open,temperature,cumulative_exposure.total_minutes\n"
        "A,2024-01-01T00:00:00Z,0.5,yes,4.5,10\nA,not a time,0.5,1,1,1\nB,2024-01-01T00:00:01+00:00,x,1.0,,\n")
    got = training.read_training_csv(spark, path).orderBy("asset_id").collect()
    assert [(r["asset_id"], r["risk_proxy"], r["door_open"], r["temperature"], r["total_minutes"], r["scenario"]) for r in got] == [
        ("A", 0.5, 1, 4.5, 10.0, "unknown"), ("B", 0.0, 0, 0.0, 0.0, "unknown")]
    (tmp_path / "bad.csv").write_text("asset_id,timestamp\nA,2024\n")
    with pytest.raises(ValueError, match="risk_proxy"):
        training.read_training_csv(spark, str(tmp_path / "bad.csv"))


def test_training_reports(spark, tmp_path):
    training.write_history(spark, [{"epoch": 1, "train_loss": 0.1, "val_loss": 0.2, "val_rmse": 0.3, "lr": 0.01}], str(tmp_path / "h"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "h")).first()["val_rmse"] == "0.3"
    training.write_metadata(spark, {"seq_len": 30}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"seq_len": 30}


def test_upsert_last_write_wins_and_repeated_batch_changes_nothing(spark, tmp_path):
    table = tables.UpsertTable(spark, str(tmp_path / "p"), ["k"], ["v"])
    table.write(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int"), 0)
    table.write(spark.createDataFrame([("a", 0)], "k string, v int"), 1)
    table.write(spark.createDataFrame([("a", 0)], "k string, v int"), 1)
    expected = [("a", 0), ("b", 1)]
    assert sorted(tuple(r) for r in table.read().collect()) == expected
    assert sorted(tuple(r) for r in table.compact(str(tmp_path / "q")).read().collect()) == expected


def test_append_and_incremental_read_skip_old_days(spark, tmp_path):
    rows = [("A", f"2024-01-0{d} 00:00:0{s}") for d in range(1, 6) for s in range(3)]
    df = spark.createDataFrame(rows, "asset_id string, t string").select("asset_id", F.col("t").cast("timestamp").alias("ts"))
    tables.append_readings(df, str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    got = tables.read_batch(stored, ("2024-01-04 00:00:00",), ["asset_id", "ts"], limit=4, ties=["asset_id"])
    assert [str(r["ts"]) for r in got.collect()] == ["2024-01-04 00:00:01", "2024-01-04 00:00:02", "2024-01-05 00:00:00", "2024-01-05 00:00:01"]
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in got._jdf.queryExecution().toString()


def test_reading_batch_by_batch_gives_every_row_once(spark):
    df = spark.createDataFrame([(i, f"2024-01-01 00:00:0{i // 5}") for i in range(23)], "event_id bigint, t string")
    df = df.select("event_id", F.col("t").cast("timestamp").alias("ts"))
    last, seen = None, []
    while batch := tables.read_batch(df, last, ["ts", "event_id"], limit=3).collect():
        assert len(batch) <= 3
        seen += [r["event_id"] for r in batch]
        last = (str(batch[-1]["ts"]), batch[-1]["event_id"])
    assert seen == list(range(23))
    numbered = {r["event_id"]: r["batch"] for r in tables.in_batches(df, ties=["event_id"], size=3).collect()}
    assert numbered == {i: i // 3 for i in range(23)}


def test_upserts_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    for n, rows in enumerate(([("a", 1), ("a", 2)], [("a", 2), ("a", 1)])):
        table = tables.UpsertTable(spark, str(tmp_path / str(n)), ["k"])
        table.write(spark.createDataFrame(rows, "k string, v int"), 0)
        assert [tuple(r) for r in table.read().collect()] == [("a", 2)]


def test_builtin_corpus_counts(spark):
    """Counts of the 32 built-in documents."""
    documents = guidance.merge(guidance.builtin_documents(spark))
    counted = {(r["section"], r["key"]): r["documents"] for r in guidance.summary(documents).collect()}
    assert counted[("document_count", "")] == 32
    categories = {
        "cargo": 10, "cooling": 1, "correlation": 1, "decision": 1, "door": 1, "equipment": 1, "exposure": 1, "humidity": 1, "messaging": 1,
        "notification": 2, "rag": 1, "risk": 1, "routing": 2, "scenario": 3, "schema": 3, "temperature": 1, "vibration": 1,
    }
    assert {k: n for (s, k), n in counted.items() if s == "categories"} == categories
    assert counted[("cargo_types", "all")] == 22 and counted[("sources", "Internal Cargo Policy")] == 10
    row = documents.filter("id = 'sop-cargo-icecream'").first()
    assert row["title"] == "Ice Cream handling baseline" and row["content"].startswith("Ice cream is highly sensitive")


def test_documents_from_files(spark, tmp_path):
    folder = tmp_path / "sopdocuments"
    (folder / "deep").mkdir(parents=True)
    (folder / "a-note.md").write_text("\n# Heading   one\nbody\n")
    (folder / "deep" / "B.TXT").write_text("plain text")
    (folder / "empty.md").write_text("  \n")
    (folder / "skip.csv").write_text("no")
    (folder / "c.json").write_text(json.dumps([
        {"id": "x", "content": "first", "metadata": {"category": "k", "priority": 9}}, {"title": "no content"}, 5,
        {"id": "x", "text": "second"}, {"document": "third line\nmore"}]))
    (folder / "d.json").write_text(json.dumps({"content": "solo", "title": "T", "metadata": "none"}))
    (folder / "e.json").write_text("{broken")
    texts = {r["path"]: r for r in guidance.text_documents(spark, str(folder)).collect()}
    assert set(texts) == {"sopdocuments/a-note.md", "sopdocuments/deep/B.TXT"}
    note = texts["sopdocuments/a-note.md"]
    assert note["title"] == "Heading one" and note["keywords"] == "external sop a-note"
    assert note["id"] == "external-text-" + hashlib.sha1(b"sopdocuments/a-note.md").hexdigest()[:12]
    objects = guidance.json_documents(spark, str(folder))
    assert sorted(r["content"] for r in objects.collect()) == ["first", "second", "solo", "third line\nmore"]
    third = objects.filter("content like 'third%'").first()
    assert third["id"] == "external-c-" + hashlib.sha1(b"third line\nthird line\nmore").hexdigest()[:12]
    merged = guidance.merge(guidance.builtin_documents(spark), guidance.text_documents(spark, str(folder)), objects)
    assert merged.count() == 32 + 2 + 3
    x = merged.filter("id = 'x'").first()
    assert (x["content"], x["category"], x["priority"]) == ("second", "external", 5)
    guidance.write_manifest(merged, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest" / "document_ids")).count() == 37


def test_alert_history_filters(spark):
    df = spark.createDataFrame([("A", "high", "reroute"), ("A", "low", "system"), ("B", "high", "Reroute ")], "asset_id string, severity string, alert_type string")
    assert alerts.history(df).count() == 3
    assert alerts.history(df, asset_id="A", severity_word="URGENT").count() == 1
    assert alerts.history(df, kind=" reroute").count() == 2


def test_prompts_hold_documents_and_task(spark):
    from frostline.operators import decisions

    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in decisions.ACTION_FIELDS.items()) + ">>"
    df = spark.sql(f"""select 'A' as asset_id, timestamp '2024-01-01' as ts, timestamp '2024-01-01' as prediction_ts, 'meat' as cargo_type,
      1.0D as gps_lat, 2.0D as gps_lon, 9.0D as temperature, 50.0D as humidity, 1.0D as vibration, false as door_open, 'normal' as scenario,
      false as refrigeration_failed, 0.2D as risk_proxy, 3.0D as temp_degree_minutes, 0.5D as predicted_risk_proxy, 0.5D as combined_score,
      cast(null as double) as time_to_failure_hours, 'moderate' as urgency, 'moderate' as risk_level, array('a') as contributing_factors,
      0.5D as risk_score, true as requires_action, 'above_range' as temperature_status, cast(array() as {kind}) as actions,
      array(named_struct('id', 'sop-x', 'content', ' text ', 'source', 'S', 'category', 'c', 'type', cast(null as string))) as sops""")
    got = explain.prompts(df).first()
    assert "[sop-x] text (source=S, category=c)" in got["risk_user"] and "under 180 words" in got["risk_user"]
    assert "- No actions listed" in got["decision_user"] and "Time to Failure (hours): None" in got["decision_user"]


def test_profiles_are_inline_tables(spark):
    assert profiles.cargo_profiles(spark).count() == 10 and profiles.rooms(spark).count() == 5
    assert profiles.default_centres(spark).filter("array_contains(supported_cargo_types, 'meat')").count() == 3


def test_each_action_of_a_decision_is_decoded_once(spark):
    listed = [
        {"type": " Reroute", "etahours": "1.5", "benefitscore": 80, "targetdc": "DC_1", "dcname": "One", "recommendedaction": "go"},
        {"actiontype": "NOTIFY", "eta_hours": "soon", "benefit_score": None, "priority": "HIGH", "description": " d ", "tool": "x"},
        7,
        {},
    ]
    got = msg.normalise_decision(msg.decode(sent(spark, ("x", {"actions": listed, "analysis": {"riskscore": 0.5}}))))
    # The message, its analysis, factors, actions, results, reading and prediction, and each action.
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json(") <= 8
    assert [tuple(a) for a in got.first()["actions"]] == [
        ("reroute", "", "medium", "", "go", "DC_1", "One", 1.5, 80.0), ("notify", "d", "high", "x", "", "", "", 0.0, 0.0), ("unknown", "", "medium", "", "", "", "", 0.0, 0.0),
    ]
