"""The leveled table against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from frostline.session import work_path
from frostline.sources.leveled import LeveledTable

ROW = "k long, t string, v long"


def rows_of(df):
    return {(r["k"], r["t"]): r["v"] for r in df.collect()}


def test_many_batches_few_runs(spark):
    rng = random.Random(1)
    table, want, batches = LeveledTable(spark, work_path(spark, "leveled"), ["k", "t"], ["v"], buckets=4), {}, {}
    for batch in range(21):
        rows = [(rng.randrange(60), rng.choice("ab"), rng.randrange(1000)) for _ in range(12)]
        df = spark.createDataFrame(rows, ROW)
        table.write(df, batch)
        if batch % 5 == 0:
            # Taken again after a failure.
            table.write(df, batch)
        own = {}
        for k, t, v in rows:
            own[k, t] = max(v, own.get((k, t), -1))
        want |= own
        batches |= dict.fromkeys(own, batch)
    now = table.manifest()
    assert [r["level"] for r in sorted(now["runs"], key=lambda r: r["high"])] == [2, 1, 0] and now["last"] == 20
    assert rows_of(table.read()) == want
    keys = spark.createDataFrame([(5, "a"), (7, "b"), (99, "a")], "k long, t string")
    found = table.lookup(keys)
    assert rows_of(found) == {key: want[key] for key in ((5, "a"), (7, "b")) if key in want}
    assert rows_of(table.changes(17)) == {key: want[key] for key, b in batches.items() if b > 17}
    assert {r["batch"] for r in table.changes(17).collect()} <= {18, 19, 20} and table.changes(20).collect() == []
    assert table.vacuum() > 0 and table.vacuum() == 0 and rows_of(table.read()) == want


def test_lost_writes_and_two_writers(spark):
    table = LeveledTable(spark, work_path(spark, "leveled"), ["k"])
    one, two = (spark.createDataFrame([(1, "x", v)], ROW) for v in (1, 2))
    table.write(one, 0)
    before = table.manifest()
    # A run without a manifest, as a writer leaves it that is lost before its commit.
    table._write_run(two.withColumn("_batch", F.lit(1).cast("long")), 0, 1, 1)
    assert rows_of(table.read()) == {(1, "x"): 1}
    table.write(two, 1)
    assert rows_of(table.read()) == {(1, "x"): 2}
    with pytest.raises(RuntimeError):
        table._commit(before, 5, [])
    assert rows_of(table.read()) == {(1, "x"): 2} and table.vacuum() == 1


def test_new_columns_and_empty_batches(spark):
    table = LeveledTable(spark, work_path(spark, "leveled"), ["k"], fanout=2)
    table.write(spark.createDataFrame([(1, "x", 1)], ROW), 0)
    table.write(spark.createDataFrame([], ROW), 1)
    table.write(spark.createDataFrame([(2, "y", 2, 0.5)], ROW + ", w double"), 2)
    assert sorted((r["k"], r["w"]) for r in table.read().collect()) == [(1, None), (2, 0.5)]
