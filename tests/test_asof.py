"""One flow of several sides, and the hourly counter over ranges, against step-by-step Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import asof, hourly

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_of_three_kinds(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["A", "A", "B"]), START + dt.timedelta(seconds=rng.randrange(0, 20_000) // 50 * 50), i, rng.randrange(3)) for i in range(300)] + [(None, START, 900, 0), ("A", None, 901, 1)]
    sides = [asof.tagged(spark.createDataFrame([r[:3] for r in rows if r[3] == k], "asset string, ts timestamp, id long"), k, "asset", order="id") for k in range(3)]
    got = asof.with_neighbours(asof.flow_of(*sides), 900, [0, 2], following=True, once=1).collect()
    want = {}
    for asset in "AB":
        own = sorted((r for r in rows if r[0] == asset and r[1]), key=lambda r: (r[1], r[3], r[2]))
        seen, kept = set(), []
        for r in own:
            if r[3] != 1 or r[1] not in seen:
                kept.append(r)
            if r[3] == 1:
                seen.add(r[1])
        for i, r in enumerate(kept):
            back = {k: next((x[2] for x in reversed(kept[: i + 1]) if x[3] == k and (r[1] - x[1]).total_seconds() <= 900), None) for k in (0, 2)}
            after = kept[i + 1] if i + 1 < len(kept) and (kept[i + 1][1] - r[1]).total_seconds() <= 900 else None
            want[r[2]] = (back[0], back[2], after and (after[3], after[2]))
    mine = {}
    for r in got:
        near = lambda b, k: b[f"row{k}"]["id"] if b is not None and (r["_ts"] - b["at"]).total_seconds() <= 900 else None  # noqa: B023, E731
        after = r["next"] if r["next"] is not None and (r["next"]["at"] - r["_ts"]).total_seconds() <= 900 else None
        mine[r["_order"]] = (near(r["back0"], 0), near(r["back2"], 2), after and (after["kind"], after[f"row{after['kind']}"]["id"]))
    assert mine == want and len(got) == len(want)


@pytest.mark.parametrize("whole", [0, 150, 100_000])
def test_keys_stay_whole_or_are_cut(spark, monkeypatch, whole):
    """Small keys send no edges; matches are the same however many keys are cut."""
    rng = random.Random(7)
    names = ["HOT"] * 6 + [f"T{i}" for i in range(8)]
    sides = [
        spark.createDataFrame([(rng.choice(names), i, START + dt.timedelta(seconds=rng.randrange(60_000) // 20 * 20)) for i in range(400)] + [(None, 900, START), ("HOT", 901, None)], "asset string, id long, ts timestamp")
        for _ in range(2)
    ]
    monkeypatch.setattr(asof, "WHOLE", whole)
    cut = [r[0] for r in asof.large_keys("asset", *sides).collect() if r[0]]
    assert sorted(cut) == (sorted(set(names)) if whole == 0 else ["HOT"] if whole == 150 else [])
    flow = asof.flow_of(*[asof.tagged(side, k, "asset", order="id") for k, side in enumerate(reversed(sides))])
    dealt = asof.with_neighbours(flow, 900, [asof.RIGHT], True, cut=asof.large_keys("asset", *sides))
    assert {r[0] for r in dealt.filter("_bucket is not null").select("_key").distinct().collect()} == set(cut)
    found = lambda: sorted((r[0], r[1] if r[1] is not None else -1, r[2]) for r in asof.match_latest(*sides, "asset", left_order="id", right_order="id", max_age_s=900, wait_s=600).select("left.id", "right.id", "waited").collect())
    mine = found()
    monkeypatch.setattr(asof, "WHOLE", 0)
    assert mine == found() and len(mine) == 400


def by_hand(steps, units):
    hour = done = 0
    out = []
    for s, u in zip(steps, units, strict=True):
        hour += s
        if hour >= hourly.HOUR:
            hour = done = 0
        done += s * u
        out.append(done)
    return out


def test_functions_of_ranges_compose():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        step = rng.choice([0, 1, 7, 20, 59, 60, 61, 200], n) * 60_000_000
        units = rng.integers(0, 30, n)
        want = by_hand(step.tolist(), units.tolist())
        cuts = np.sort(rng.integers(0, n + 1, 4))
        hour = done = 0
        got = []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            s, u = step[a:b], (units * step)[a:b]
            got += hourly.run(s, u, hour, done).tolist()
            made = hourly.function_of(s, u)
            hour, done = hourly.applied(hour, done, *(made[c].to_numpy() for c in made.columns))
        assert got == want


def test_counter_of_an_asset_with_most_rows(spark):
    rng = random.Random(4)
    rows = [("A" if rng.random() < 0.9 else rng.choice("BC"), i, START + dt.timedelta(seconds=30 * i), rng.choice([1, 5, 13, 61]), rng.randrange(30)) for i in range(2_000)]
    rows += [("A", 5_000, None, 3, 2), (None, 5_001, START, 1, 1), ("C", 5_002, START, None, None)]
    df = spark.createDataFrame(rows, "asset string, id long, ts timestamp, minutes long, units long").repartition(5)
    got = {r["id"]: r["counter"] for r in hourly.hourly_counter(df, "asset", ["ts", "id"], F.col("minutes") * 60_000_000, F.col("units"), "counter").collect()}
    want = {}
    for asset in "ABC":
        own = sorted((r for r in rows if r[0] == asset), key=lambda r: (r[2] is not None, r[2], r[1]))
        want |= dict(zip([r[1] for r in own], by_hand([(r[3] or 0) * 60_000_000 for r in own], [r[4] or 0 for r in own]), strict=True))
    assert got == want


def test_counter_without_rows(spark):
    none = spark.createDataFrame([], "asset string, id long, ts timestamp, minutes long, units long")
    assert hourly.hourly_counter(none, "asset", ["ts", "id"], F.col("minutes"), F.col("units"), "counter").collect() == []


def test_small_assets_share_a_call_of_the_hourly_counter(spark):
    rng = random.Random(11)
    rows = [(f"A{a}", i, START + dt.timedelta(minutes=rng.randrange(600)), rng.randrange(1, 50), rng.randrange(3)) for a in range(200) for i in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(rows, "asset string, id int, ts timestamp, minutes long, units int").repartition(3)
    found = hourly.hourly_counter(df, "asset", ["ts", "id"], F.col("minutes") * 60_000_000, F.col("units"), "counter")
    assert "FlatMapGroupsInPandas [_chunk" in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for asset in {r[0] for r in rows}:
        hour = done = 0
        for r in sorted((r for r in rows if r[0] == asset), key=lambda r: (r[2], r[1])):
            step = r[3] * 60_000_000
            hour, done = (0, 0) if hour + step >= hourly.HOUR else (hour + step, done)
            done += r[4] * step
            want[asset, r[1]] = done
    assert {(r["asset"], r["id"]): r["counter"] for r in found.collect()} == want
