"""Value parsing, rounding and text expressions against plain Python."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.functions import numeric, text, values


def evaluate(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    numbers = [1.005, 2.675, 0.125, 0.375, 1.115, 0.285, 0.545, -1.005, -0.125, 0.0, 2.5, 3.5, 1e-9, 123456.785]
    numbers += [rng.randrange(-10**6, 10**6) / 1000 for _ in range(4000)]
    numbers += [rng.uniform(-500, 500) for _ in range(2000)]
    for digits in (1, 2, 3):
        got = evaluate(spark, [(x,) for x in numbers], "x double", r=numeric.round_to("x", digits))
        assert [r[0] for r in got] == [round(x, digits) + 0.0 for x in numbers]


def test_rounding_keeps_nan(spark):
    assert math.isnan(evaluate(spark, [(float("nan"),)], "x double", r=numeric.round_to("x", 2))[0][0])


def test_plain_numbers_print_as_python_does(spark):
    numbers = [5.0, 0.001, 12345678.5, 20.0, -3.25, 0.1, 1e7, 0.0]
    got = evaluate(spark, [(x,) for x in numbers], "x double", r=numeric.plain("x", 3), f=numeric.fixed("x", 2))
    assert [r[0] for r in got] == [repr(round(x, 3)) if x < 1e16 else None for x in numbers]
    assert [r[1] for r in got] == [f"{x:.2f}" for x in numbers]


@pytest.mark.parametrize(
    "raw, expected",
    [(None, 7.0), ("3.5", 3.5), (" 2 ", 2.0), ("abc", 7.0), ("", 7.0), ("true", 1.0), ("False", 0.0), ("1e2", 100.0),
     ("1.5f", 7.0), ("1_000", 1000.0), ("-4", -4.0), ("inf", math.inf)],
)
def test_number(spark, raw, expected):
    assert evaluate(spark, [(raw,)], "x string", r=values.number("x", 7.0)) == [(expected,)]


def test_number_keeps_nan(spark):
    assert math.isnan(evaluate(spark, [("nan",)], "x string", r=values.number("x"))[0][0])


@pytest.mark.parametrize(
    "raw, expected",
    [("Yes", True), (" on ", True), ("1", True), ("1.0", False), ("TRUE", True), ("y", True), ("no", False), ("", False), (None, False)],
)
def test_truth(spark, raw, expected):
    assert evaluate(spark, [(raw,)], "x string", r=values.truth("x")) == [(expected,)]


def test_risk_score_does_not_try_the_next_alias_after_bad_text(spark):
    rows = [("bad", "0.4"), (None, "0.4"), ("1.7", None), (None, None)]
    df = spark.createDataFrame(rows, "predicted_risk_proxy string, risk_score string")
    assert [r[0] for r in df.select(values.risk_score(df.columns)).collect()] == [0.0, 0.4, 1.0, 0.0]


def test_negative_hours_are_unknown(spark):
    df = spark.createDataFrame([("-1", "5"), (None, "5"), ("0", None), ("x", None)], "time_to_failure_hours string, timetofailure string")
    assert [r[0] for r in df.select(values.hours_to_failure(df.columns)).collect()] == [None, 5.0, 0.0, None]


def test_clamp_sends_nan_to_the_upper_limit(spark):
    assert evaluate(spark, [(float("nan"),), (-1.0,), (2.0,), (0.3,)], "x double", r=values.unit("x")) == [(1.0,), (0.0,), (1.0,), (0.3,)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_text_helpers(spark, texts):
    clean = [t for t in texts if "\x00" not in t and t.isprintable()]
    if not clean:
        return
    got = evaluate(spark, [(t,) for t in clean], "x string", c=text.compact("x"), s=text.slug("x"), i=text.stable_id("p", "x"))
    for t, (compact, slug, ident) in zip(clean, got):
        assert compact == re.sub(r"\s+", " ", t).strip()
        expected = re.sub(r"[^a-zA-Z0-9]+", "-", t.strip().lower())
        assert slug == (re.sub(r"-{2,}", "-", expected).strip("-") or "document")
        assert ident == "p-" + hashlib.sha1(t.encode()).hexdigest()[:12]


def test_first_line(spark):
    rows = [("\n\n## Title here \nmore",), ("   \n#\n",), ("x" * 200,), ("one\rtwo",)]
    got = evaluate(spark, rows, "x string", r=text.first_line("x", F.lit("fallback")))
    assert got == [("Title here",), ("fallback",), ("x" * 140,), ("one",)]


def test_cargo_names(spark):
    rows = [("frozenfood",), ("blood_plasma",), ("dairy",), ("icecream",)]
    assert evaluate(spark, rows, "x string", r=text.cargo_display("x")) == [("Frozen Food",), ("Blood Plasma",), ("Dairy",), ("Ice Cream",)]


def test_haversine(spark):
    got = evaluate(spark, [(27.1767, 78.0081, 28.7041, 77.1025)], "a double, b double, c double, d double", r=numeric.haversine_km("a", "b", "c", "d"))
    assert abs(got[0][0] - 191.9) < 0.5


def test_failure_hours(spark):
    got = evaluate(spark, [(0.0,), (1.0,), (0.5,), (2.0,), (-1.0,)], "x double", r=numeric.failure_hours("x"))
    assert [r[0] for r in got] == [72.0, 6.0, 39.0, 6.0, 72.0]


def test_folders_of_one_machine_are_told():
    from frostline.session import perhaps_local

    assert perhaps_local("file:/tmp/w", "spark://a:7077") and perhaps_local("/tmp/w", "yarn")
    assert not perhaps_local("file:/tmp/w", "local[8]") and not perhaps_local("hdfs://a/w", "yarn") and not perhaps_local("s3a://a/w", "k8s://a")
