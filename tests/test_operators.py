"""Distributed operators against brute force on small fixtures, skewed ones included."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.data import profiles
from frostline.operators import asof, decisions, exposure, features, latest, nearest, retrieval, routing, running

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def skewed_rows(n, seed=1, span=86400 * 4):
    """A third of all rows belong to one asset."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        asset = "HOT" if rng.random() < 1 / 3 else f"T{rng.randrange(12)}"
        rows.append((asset, i, at(rng.randrange(span)), rng.randrange(-50, 300) / 10, rng.random() < 0.3))
    return rows


def test_running_sums_and_previous_values_across_chunks(spark):
    rows = skewed_rows(900)
    df = spark.createDataFrame(rows, "asset_id string, event_id bigint, ts timestamp, temperature double, door_open boolean")
    for chunk in (None, F.date_trunc("hour", "ts"), F.date_trunc("year", "ts")):
        got = running.running(
            df, "asset_id", ("ts", "event_id"), {"n": F.lit(1), "s": F.round(F.col("temperature") * 10).cast("bigint")},
            {"was": "door_open"}, chunk,
        ).collect()
        assert len(got) == len(rows)
        by_id = {r["event_id"]: r for r in got}
        for asset in {r[0] for r in rows}:
            total, before = 0, None
            for i, r in enumerate(sorted((r for r in rows if r[0] == asset), key=lambda r: (r[2], r[1])), 1):
                total += round(r[3] * 10)
                mine = by_id[r[1]]
                assert (mine["n"], mine["s"], mine["was"]) == (i, total, before)
                before = r[4]


def test_a_key_with_most_rows_of_one_day_is_spread(spark):
    rows = [("HOT" if i % 10 else f"T{i}", i, at(i // 50) if i % 97 else None, i % 7 == 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "asset_id string, event_id bigint, ts timestamp, door_open boolean").repartition(6)
    dealt = running.ranged(df, "asset_id", "ts", "event_id").groupBy("_chunk").count().collect()
    assert max(r["count"] for r in dealt) < 0.6 * len(rows)
    got = {r["event_id"]: (r["n"], r["was"]) for r in running.running(df, "asset_id", ("ts", "event_id"), {"n": F.lit(1)}, {"was": "door_open"}).collect()}
    numbers = {r["event_id"]: r["number"] for r in running.numbered_rows(df, ["ts", "event_id"]).collect()}
    time = lambda r: (r[2] is not None, r[2] or START, r[1])
    assert numbers == {r[1]: i for i, r in enumerate(sorted(rows, key=time), 1)}
    seen = {}
    for asset, ident, _, is_open in sorted(rows, key=time):
        n, before = seen.get(asset, (0, None))
        assert got[ident] == (n + 1, before)
        seen[asset] = n + 1, is_open


@pytest.mark.parametrize("radius", [600.0, 1500.0])
def test_nearest_centres_at_any_radius(spark, radius):
    rng = random.Random(radius)
    centres = [(f"C{i}", "n", rng.uniform(10, 35), rng.uniform(65, 90), 10, 0, "operational", ["meat"], 1) for i in range(8)]
    readings = [("A", i, rng.uniform(10, 35), rng.uniform(65, 90), "meat") for i in range(30)] + [("A", 100 + i, 20.0, 70.0, "meat") for i in range(60)]
    df = spark.createDataFrame(readings, "asset_id string, event_id bigint, gps_lat double, gps_lon double, cargo_type string")
    got = nearest.nearest_centres(df, nearest.eligible(spark.createDataFrame(centres, profiles.CENTRE_SCHEMA)), ["event_id"], 3, radius).collect()
    assert {(r["event_id"], r["rank"]): r["centre"]["id"] for r in got} == nearest_by_hand(readings, centres, 3, radius)


def cache_simulation(predictions, readings, age, wait):
    """What a service with a cache per asset does, one message after another."""
    out = {}
    messages = [(r[2], 0, r[1], r[0]) for r in readings] + [(p[2], 1, p[1], p[0]) for p in predictions]
    last, pending = {}, {}
    for ts, kind, ident, asset in sorted(messages):
        if kind == 0:
            last[asset] = (ts, ident)
            if asset in pending:
                p_ts, p = pending.pop(asset)
                if (ts - p_ts).total_seconds() <= wait:
                    out[p] = (ident, True)
        else:
            pending.pop(asset, None)
            if asset in last and (ts - last[asset][0]).total_seconds() <= age:
                out[ident] = (last[asset][1], False)
            else:
                pending[asset] = (ts, ident)
    return out


@pytest.mark.parametrize("age, wait", [(1800, 900), (600, 1800), (60, 60)])
def test_matching_equals_a_cache_per_asset(spark, age, wait):
    rng = random.Random(age)
    assets = ["HOT"] * 4 + [f"T{i}" for i in range(6)]
    readings = [(rng.choice(assets), i, at(rng.randrange(40000))) for i in range(500)]
    predictions = [(rng.choice(assets), i, at(rng.randrange(40000))) for i in range(600)]
    left = spark.createDataFrame(predictions, "asset_id string, prediction_id bigint, ts timestamp")
    right = spark.createDataFrame(readings, "asset_id string, event_id bigint, ts timestamp")
    got = asof.match_latest(left, right, "asset_id", left_order="prediction_id", right_order="event_id", max_age_s=age, wait_s=wait)
    rows = got.select("left.prediction_id", "right.event_id", "waited").collect()
    assert len(rows) == len(predictions)
    assert {r[0]: (r[1], r[2]) for r in rows if r[1] is not None} == cache_simulation(predictions, readings, age, wait)


def test_equal_times_and_exact_ages_match(spark):
    left = spark.createDataFrame([("A", 1, at(1800)), ("B", 2, at(0)), ("C", 3, at(1801)), ("D", 4, at(0))], "asset_id string, prediction_id bigint, ts timestamp")
    right = spark.createDataFrame([("A", 1, at(0)), ("B", 2, at(900)), ("C", 3, at(0)), ("D", 4, at(901))], "asset_id string, event_id bigint, ts timestamp")
    got = asof.match_latest(left, right, "asset_id", left_order="prediction_id", right_order="event_id", max_age_s=1800, wait_s=900)
    assert {r["left"]["prediction_id"]: r["right"] and r["right"]["event_id"] for r in got.collect()} == {1: 1, 2: 2, 3: None, 4: None}


def great_circle(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))


def nearest_by_hand(readings, centres, k, radius):
    out = {}
    for asset, ident, lat, lon, cargo in readings:
        if lat is None or lon is None:
            continue
        found = []
        for c in centres:
            free = max(0, c[4] - c[5])
            if free < 1 or c[6] != "operational" or (cargo and cargo not in c[7]):
                continue
            km = great_circle(lat, lon, c[2], c[3])
            if km <= radius:
                found.append((round(km, 2), -free, c[8], c[0]))
        for rank, f in enumerate(sorted(found)[:k], 1):
            out[(ident, rank)] = f[3]
    return out


@pytest.mark.parametrize("spread", ["sparse", "dense", "poles"])
def test_nearest_centres_equal_brute_force(spark, spread):
    rng = random.Random(spread)
    kinds = ["vaccines", "meat", "dairy"]
    if spread == "sparse":
        place = lambda: (rng.uniform(20, 35), rng.uniform(70, 85))
    elif spread == "dense":
        place = lambda: (28.0 + rng.choice([0.0, rng.gauss(0, 0.02), rng.uniform(-3, 3)]), 77.0 + rng.choice([0.0, rng.gauss(0, 0.02)]))
    else:
        place = lambda: (rng.choice([89.5, -89.9, 0.1]) + rng.uniform(-0.09, 0.09), rng.choice([-179.9, 179.9, 10.0]))
    centres = [
        (f"C{i:03d}", f"n{i}", *place(), 10, rng.choice([0, 3, 10]), rng.choice(["operational"] * 4 + ["maintenance"]),
         rng.sample(kinds, rng.randrange(1, 4)), rng.randrange(1, 4))
        for i in range(120)
    ]
    # Many centres at one point, equal in all but priority and id.
    centres += [(f"S{i:02d}", "same", 28.0, 77.0, 10, 0, "operational", kinds, 1 + i % 2) for i in range(15)]
    readings = [("A" if i % 3 else "HOT", i, *place(), rng.choice([*kinds, None, " Meat "])) for i in range(150)]
    readings += [("A", 900, None, 77.0, "meat"), ("A", 901, 28.0, 77.0, "meat"), ("A", 902, -60.0, 0.0, "meat")]
    df = spark.createDataFrame(readings, "asset_id string, event_id bigint, gps_lat double, gps_lon double, cargo_type string")
    cd = spark.createDataFrame(centres, profiles.CENTRE_SCHEMA)
    got = nearest.nearest_centres(df, nearest.eligible(cd), ["event_id"], 4, 350.0).collect()
    clean = [(a, i, lat, lon, cargo and cargo.strip().lower()) for a, i, lat, lon, cargo in readings]
    assert {(r["event_id"], r["rank"]): r["centre"]["id"] for r in got} == nearest_by_hand(clean, centres, 4, 350.0)


def test_default_network_and_exclusion(spark):
    df = spark.createDataFrame([(1, 27.18, 78.0, "vaccines"), (2, 26.5, 80.3, "ice_cream")], "event_id bigint, gps_lat double, gps_lon double, cargo_type string")
    open_ = nearest.eligible(profiles.default_centres(spark))
    got = nearest.nearest_centres(df, open_, ["event_id"], 2).orderBy("event_id", "rank").collect()
    assert [r["centre"]["id"] for r in got] == ["DC_AGRA", "DC_FIROZABAD", "DC_KANPUR", "DC_AGRA"]
    gone = spark.createDataFrame([(" dc_agra ",)], "id string")
    got = nearest.nearest_centres(df, nearest.without(open_, gone), ["event_id"], 1).orderBy("event_id").collect()
    assert [r["centre"]["id"] for r in got] == ["DC_FIROZABAD", "DC_KANPUR"]


def test_centre_descriptions_get_defaults(spark):
    schema = "id string, name string, lat string, lon string, distance_km string, eta_hours string, capacity string, current_load string, available_capacity string, refrigeration_status string, priority_rank string"
    df = spark.createDataFrame([(None, None, "1", "x", "90", None, "5.7", None, None, None, None)], schema)
    got = routing.describe_centre(df).first()
    assert (got["id"], got["lon"], got["eta_hours"], got["capacity"], got["priority_rank"]) == ("UNKNOWN_DC", 0.0, 2.0, 5, 99)


def test_benefit_is_zero_when_the_centre_cannot_be_used(spark):
    schema = ("asset_id string, prediction_id bigint, scenario string, refrigeration_failed boolean, combined_score double, "
              "time_to_failure_hours double, cargo_type string, distance_km double, "
              "centre struct<id:string,name:string,lat:double,lon:double,capacity:int,current_load:int,available_capacity:int,"
              "refrigeration_status:string,supported_cargo_types:array<string>,priority_rank:int>")
    def dc(free=5, status="operational", kinds=("meat",)):
        return ("C", "c", 0.0, 0.0, 10, 10 - free, free, status, list(kinds), 1)
    rows = [("a", 1, "normal", False, 0.9, None, "meat", 90.0, dc()), ("a", 2, "normal", False, 0.9, 1.0, "meat", 90.0, dc()),
            ("a", 3, "normal", False, 0.9, None, "meat", 90.0, dc(0)), ("a", 4, "normal", False, 0.9, None, "meat", 90.0, dc(status="down")),
            ("a", 5, "normal", False, 0.9, None, "fish", 90.0, dc()), ("a", 6, "normal", False, 0.9, 2.0, "meat", 90.0, dc())]
    got = {r["prediction_id"]: r for r in routing.benefit(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i]["benefit_score"] for i in (2, 3, 4, 5)] == [0.0] * 4
    assert got[1]["benefit_score"] == round(100 * (0.3 * 0.5 + 0.25 * (1 - 90 / 350) + 0.2 * 0.5 + 0.15 + 0.10 + 0.03), 2)
    assert got[6]["can_arrive_before_failure"] and got[6]["eta_buffer_hours"] == 0.0
    assert "ETA exceeds failure window by 1.0 hours" in got[2]["benefit_rationale"]


def test_offers_stay_in_the_row_of_their_case(spark):
    """Cases with one pair of keys keep their own offers, and those that are not urgent, or have no place or no centre near, stay too."""
    rng = random.Random(5)
    centres = [(f"C{i:02d}", f"n{i}", 28 + rng.uniform(-1, 1), 77 + rng.uniform(-1, 1), 10, rng.choice([0, 4]), "operational", ["meat"], 1) for i in range(20)]
    schema = ("asset_id string, prediction_id bigint, gps_lat double, gps_lon double, cargo_type string, scenario string, refrigeration_failed boolean, "
              "combined_score double, time_to_failure_hours double, risk_level string")
    rows = [("A", 1, 28.0, 77.0, "meat", "normal", False, 0.8, None, "high"), ("A", 1, 28.9, 77.9, "meat", "normal", False, 0.97, 5.0, "critical"),
            ("B", 2, 28.0, 77.0, "meat", "normal", True, 0.8, 0.1, "high"), ("C", 3, None, 77.0, "meat", "normal", False, 0.8, None, "high"),
            ("D", 4, -40.0, 0.0, "meat", "normal", False, 0.8, None, "high"), ("E", 5, 28.0, 77.0, "meat", "normal", False, 0.1, None, "low"),
            ("F", 6, 28.0, 77.0, "meat", "normal", False, 0.1, None, None)]
    cases, open_ = spark.createDataFrame(rows, schema), spark.createDataFrame(centres, profiles.CENTRE_SCHEMA)
    got = decisions.with_reroute(cases, open_).collect()
    assert sorted(tuple(r)[:2] for r in got) == sorted(r[:2] for r in rows)
    by = {(r["asset_id"], r["combined_score"]): r for r in got}
    for (asset, score), r in by.items():
        assert (r["alternatives"] is None) == (asset in "CDEF"), asset
        if r["alternatives"] is None:
            assert r["recommended_dc"] is None
            continue
        want = 3 if r["risk_level"] == "critical" else 2
        near = sorted((round(great_circle(r["gps_lat"], r["gps_lon"], c[2], c[3]), 2), c[5] - c[4], c[8], c[0]) for c in centres)[: max(3, 2 * want)]
        lone = spark.createDataFrame([(*tuple(r)[:10], km, c) for km, c in [(n[0], next((x[0], x[1], x[2], x[3], x[4], x[5], x[4] - x[5], x[6], x[7], x[8]) for x in centres if x[0] == n[3])) for n in near]],
                                     schema + ", distance_km double, centre struct<id:string,name:string,lat:double,lon:double,capacity:int,current_load:int,available_capacity:int,refrigeration_status:string,supported_cargo_types:array<string>,priority_rank:int>")
        scored = sorted(routing.benefit(lone).collect(), key=lambda o: (-o["benefit_score"], o["distance_km"], -o["centre"]["available_capacity"], o["centre"]["id"]))[:want]
        assert [(d["id"], d["benefit_score"], d["rationale"]) for d in r["alternatives"]] == [(o["centre"]["id"], o["benefit_score"], o["benefit_rationale"]) for o in scored]
        assert (r["recommended_dc"] is not None) == (scored[0]["benefit_score"] > 0)


def test_route_follower(spark):
    driven = [("agra_delhi", float(d)) for d in range(-5, 260, 7)]
    got = routing.route_position(spark.createDataFrame(driven, "route string, driven_km double"), profiles.default_routes(spark)).collect()
    points = profiles.ROUTES["agra_delhi"]
    assert len(got) == len(driven)
    for r in got:
        left, here = max(0.0, r["driven_km"]), points[-1]
        for a, b in zip(points, points[1:]):
            length = great_circle(*a, *b)
            if left < length:
                here = tuple(x + (y - x) * left / length for x, y in zip(a, b))
                break
            left -= length
        assert r["lat"] == pytest.approx(here[0], abs=1e-9) and r["lon"] == pytest.approx(here[1], abs=1e-9)
        assert r["arrived"] == (here == points[-1])


def test_numbering_all_rows(spark):
    rows = skewed_rows(400, seed=9, span=3000)
    df = spark.createDataFrame(rows, "asset_id string, event_id bigint, ts timestamp, temperature double, door_open boolean")
    got = {r["event_id"]: r["number"] for r in running.numbered_rows(df, ["ts", "asset_id", "event_id"]).collect()}
    expected = {r[1]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0], r[1])), 1)}
    assert got == expected
    long = spark.createDataFrame([(1,), (1234567,)], "n bigint").select(decisions.numbered("ALERT_", F.col("n"))).collect()
    assert [r[0] for r in long] == ["ALERT_000001", "ALERT_1234567"]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(3)
    values = [rng.randrange(10**13) for _ in range(500)] + [7] * 250 + [-(10**12)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    assert features.exact_quantile(df, F.col("v"), q) == pytest.approx(float(np.quantile(values, q)), rel=1e-12)


@pytest.mark.parametrize("current", [True, False])
@pytest.mark.parametrize("block", [5, 7, 4096])
def test_sequences_across_blocks(spark, current, block):
    rows = skewed_rows(250, seed=4)
    df = spark.createDataFrame(rows, "asset_id string, event_id bigint, ts timestamp, temperature double, door_open boolean")
    got = features.sequences(df, F.col("event_id"), 5, current, block=block).select("event_id", "sequence").collect()
    expected = {}
    for asset in {r[0] for r in rows}:
        ids = [r[1] for r in sorted((r for r in rows if r[0] == asset), key=lambda r: (r[2], r[1]))]
        for i, ident in enumerate(ids):
            window = ids[i - 4 : i + 1] if current else ids[max(0, i - 5) : i]
            if len(window) == 5 and (not current or i >= 4):
                expected[ident] = window
    assert {r[0]: r[1] for r in got} == expected


def test_packed_blocks_make_up_the_series(spark):
    rows = skewed_rows(200, seed=6)
    df = spark.createDataFrame(rows, "asset_id string, event_id bigint, ts timestamp, temperature double, door_open boolean")
    blocks = features.packed(df, ["event_id"], block=16).orderBy("asset_id", "block_no").collect()
    assert max(len(b["rows"]) for b in blocks) == 16
    hot = [r["event_id"] for b in blocks if b["asset_id"] == "HOT" for r in b["rows"]]
    assert hot == [r[1] for r in sorted((r for r in rows if r[0] == "HOT"), key=lambda r: (r[2], r[1]))]


def test_features_of_unseen_and_missing_categories(spark):
    def frame(rows):
        df = spark.createDataFrame(rows, "cargo_type string, scenario string, temperature double")
        return df.withColumns({c: F.lit(1.0) for c in features.NUMERICS if c != "temperature"})
    scaling = features.fit(frame([("meat", "normal", 1.0), ("dairy", None, 3.0)]))
    assert scaling.categories == {"cargo_type": ["dairy", "meat"], "scenario": ["normal", "unknown"]}
    assert (scaling.mean["temperature"], scaling.std["temperature"], scaling.std["humidity"]) == (2.0, 1.0, 1.0)
    got = [r[0] for r in frame([("fish", " ", 3.0), ("meat", "normal", None)]).select(features.feature_vector(scaling)).collect()]
    assert got[0] == [1.0] + [0.0] * 13 + [0.0, 0.0, 0.0, 1.0]
    assert got[1] == [-2.0] + [0.0] * 13 + [0.0, 1.0, 1.0, 0.0]


@pytest.mark.parametrize("block", [16 << 20, 1000, 300])
def test_top_n_in_blocks_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    corpus, queries = rng.integers(0, 4, (60, 3)).astype(float), rng.integers(0, 4, (30, 3)).astype(float)
    c = spark.createDataFrame([(f"d{i:02d}", v.tolist()) for i, v in enumerate(corpus)], "doc_id string, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    got = retrieval.top_n(q, c, 4, block_bytes=block).collect()
    for i, v in enumerate(queries):
        distance = ((corpus - v) ** 2).sum(axis=1)
        expected = sorted((round(float(d), 6), f"d{j:02d}") for j, d in enumerate(distance))[:4]
        mine = sorted((r["rank"], r["distance"], r["doc_id"]) for r in got if r["query_id"] == i)
        assert [(d, name) for _, d, name in mine] == expected


def test_text_top_n_equals_dense_vectors(spark):
    texts = ["cold truck door", "door open door", "fish 12 fish", "", "nothing shared here", "cold cold door truck truck"]
    asked = {"q1": "door cold unknownword", "q2": "fish", "q3": "never seen"}
    terms = sorted({w for t in texts for w in t.split() if w.isalpha()})
    counts = np.array([[t.split().count(w) for w in terms] for t in texts], float)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    found = retrieval.text_top_n(
        spark.createDataFrame(list(asked.items()), "query_id string, text string"),
        spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string"), 2,
    ).collect()
    expected = set()
    for name, text in asked.items():
        q, d = np.array([text.split().count(w) for w in terms]) * idf, counts * idf
        with np.errstate(all="ignore"):
            near = d @ q / np.linalg.norm(d, axis=1) / np.linalg.norm(q)
        best = sorted((round(1 - x, 6), f"d{i}") for i, x in enumerate(near) if x > 0)[:2]
        expected |= {(name, doc, distance, rank) for rank, (distance, doc) in enumerate(best, 1)}
    assert {(r["query_id"], r["doc_id"], r["distance"], r["rank"]) for r in found} == expected


def test_exposure_never_decreases_and_risk_stays_in_range(spark):
    rng = random.Random(8)
    rows = [("T1", i, at(i * 120), rng.choice(["vaccines", "meat", "rocks"]), rng.uniform(-30, 40), rng.uniform(0, 100), rng.uniform(0, 9), rng.random() < 0.4)
            for i in range(200)]
    df = spark.createDataFrame(rows, "asset_id string, event_id bigint, ts timestamp, cargo_type string, temperature double, humidity double, vibration double, door_open boolean")
    got = exposure.with_risk(exposure.accumulate(df, profiles.cargo_profiles(spark), 2.0)).orderBy("event_id").collect()
    for c in exposure.EXPOSURE_FIELDS[:-1]:
        column = [r[c] for r in got]
        assert column == sorted(column)
    assert all(r["exposure_risk"] is None if r["cargo_type"] == "rocks" else 0 <= r["exposure_risk"] <= 1 for r in got)
    assert all(0 <= r["out_of_range_minutes_in_hour"] <= 60 * 1.45 for r in got)


def test_latest_and_changed(spark):
    rows = skewed_rows(300, seed=2)
    df = spark.createDataFrame(rows, "asset_id string, event_id bigint, ts timestamp, temperature double, door_open boolean")
    newest = {r["asset_id"]: r["event_id"] for r in latest.latest_by(df, ["asset_id"], ["ts", "event_id"]).collect()}
    kept = {r["event_id"] for r in latest.changed(df, "asset_id", "door_open", ["ts", "event_id"]).collect()}
    expected = set()
    for asset in {r[0] for r in rows}:
        series = sorted((r for r in rows if r[0] == asset), key=lambda r: (r[2], r[1]))
        assert newest[asset] == series[-1][1]
        expected |= {b[1] for a, b in zip([None, *series], series) if a is None or a[4] != b[4]}
    assert kept == expected


def test_numbering_of_rows_made_of_numbered_ones(spark, monkeypatch):
    monkeypatch.setattr(running, "STRETCH", 7)
    rows = [(n, place) for n in range(1, 60) for place in range(n % 3)]
    df = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "n bigint, place int").repartition(3)
    got = {(r["n"], r["place"]): r["number"] for r in running.numbered_within(df, "n", ["place"]).collect()}
    assert got == {row: i for i, row in enumerate(rows, 1)}
    assert running.numbered_within(df.limit(0), "n", ["place"]).collect() == []


def test_numbering_sorts_ranges_as_they_are_written(spark):
    """Numbered rows come from the written table, no window moves them again."""
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(5)
    numbered = running.numbered_rows(df, ["v"])
    assert {r["v"]: r["number"] for r in numbered.collect()} == {v: v + 1 for v in range(101)}
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_decisions_keep_the_number_their_case_has(spark):
    from frostline.plans.decide import decision_table
    from frostline.plans.tables import Tables

    records = decision_table(Tables(spark, "/root/testdata/sf0.001"))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
