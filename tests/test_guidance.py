"""Queries of cases by shape, explained cases and received records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from frostline.operators import retrieval
from frostline.plans import guidance

SOP = "array<struct<rank int, id string, content string>>"
RECORD = (
    f"explanation_id string, ts timestamp, asset_id string, decision_id string, risk_score double, explanation_text string, referenced_sops array<string>, sop_details {SOP}, "
    "telemetry_snapshot struct<ts timestamp, temperature double, scenario string, cumulative_exposure struct<temp_degree_minutes double>>, "
    "prediction_snapshot struct<predicted_risk_proxy double>, decision_snapshot struct<analysis struct<risk_level string>>, "
    "prediction_timestamp timestamp, urgency string, retrieval_query string"
)
AT = dt.datetime(2024, 1, 1, 0, 0, 1, 250)


def record(number, sops):
    details = [(i, s, f'{{"id": "no id of {s}"}}') for i, s in enumerate(sops, 1)] or None
    return (
        f"EXP-{number}", AT, "A", f"DECISION_{number}", 0.125, "Risk is \"high\"\n", list(sops), details, (AT, -3.5, "normal", (1e-9,)), (0.5,), (("low",),),
        AT, "low", "cargo | 1",
    )


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sops", [(), ("a",), ("a", "b-1", "c")])
def test_received_records_are_decoded_once(spark, sops):
    made = spark.createDataFrame([record(i, sops) for i in range(3)], RECORD)
    got = guidance.received_records(made, "prediction-explanation", "explanation_text")
    plan = plan_of(got)
    assert plan.lower().count("from_json(") == 1 and "get_json_object" not in plan
    for i, row in enumerate(sorted(got.collect(), key=lambda r: r["explanation_id"])):
        assert row["sop_ids"] == row["detail_ids"] == "|".join(sops)
        assert (row["explanation_id"], row["decision_id"], row["risk_score"], row["explanation_text"]) == (f"EXP-{i}", f"DECISION_{i}", 0.125, "Risk is \"high\"\n")
        assert (row["ts"], row["snapshot_ts"], row["prediction_timestamp"]) == (AT, AT, AT)
        assert (row["snapshot_temperature"], row["snapshot_scenario"], row["snapshot_degree_minutes"]) == (-3.5, "normal", 1e-9)
        assert (row["snapshot_level"], row["snapshot_predicted"], row["service"], row["prefix"]) == ("low", 0.5, "rag-service-1", "coldchain")


QUERIES = [
    "cargo ice_cream | temperature -2.50C | vibration 1.00g | time to failure 3.00 hours",
    "cargo ice_cream | temperature 17.25C | vibration 0.01g | time to failure 12.75 hours",
    "Überdruck 5bar x7y ΑΣ-5 ΑΣ5 | a-b",
    "Überdruck 61bar x0y ΑΣ-61 ΑΣ0 | a-b",
    "12 | 7.5",
    None,
]


def test_signatures_are_made_for_distinct_shapes(spark):
    cases = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "n int, retrieval_query string")
    asked = guidance.asked_queries(cases)
    assert asked.count() == 4
    text = retrieval.signature("retrieval_query")
    keyed = guidance.with_query_key(cases).join(asked, "query_key", "left")
    assert keyed.where(~F.col("query_id").eqNullSafe(F.md5(text)) | ~F.col("text").eqNullSafe(text)).count() == 0


def test_signatures_are_the_words_in_order(spark):
    words = spark.createDataFrame([("b A b é z1 Z",)], "q string").select(retrieval.signature("q")).first()[0]
    assert words == "a b b z z é"


def test_asked_cases_leave_their_offers_behind(spark, monkeypatch):
    offers = "array<struct<id string>>"
    decided = spark.createDataFrame([("A", QUERIES[0], [("x",)], ("x",)), ("B", QUERIES[1], None, None), ("C", QUERIES[2], None, None)],
                                    f"asset_id string, retrieval_query string, alternatives {offers}, recommended_dc struct<id string>")
    written = {}

    def materialise(df, name):
        written[name] = df.columns
        return df

    sops = guidance.with_query_key(decided.limit(1)).select("query_key", F.array(F.struct(F.lit("doc").alias("id"))).alias("sops"))
    monkeypatch.setattr(guidance, "materialise", materialise)
    monkeypatch.setattr(guidance, "urgent_decided", lambda t, numbered=False: decided)
    monkeypatch.setattr(guidance.explain, "retrieval_query", lambda cases: cases)
    monkeypatch.setattr(guidance, "shown_documents", lambda t, cases, key: sops)
    got = guidance.explained_cases(None)
    assert written["asked"] == ["asset_id", "retrieval_query", "query_key"]
    assert {r["asset_id"]: r["sop_ids"] for r in got.collect()} == {"A": ["doc"], "B": ["doc"], "C": []}
