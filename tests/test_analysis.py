"""Totals that don't depend on the order of rows, and numbers in sentences as printf of SQL writes them."""

import math
import random

import duckdb
import pytest
from loamwork.operators import analysis, rules
from pyspark.sql import functions as F

rnd = random.Random(5)
CENTS = [round(rnd.uniform(-5e5, 5e5), 2) for _ in range(20_000)]
TOTALS = {
    "cents": CENTS, "cancelled": [1e16, 1.0, -1e16, 0.1], "wide": [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-12, 12) for _ in range(3000)], "small": [1e-300, 3e-310, 5e-324],
    "large": [1e300, 2e-300, -1e300, 7e290], "whole": [float(2**53), 1.0, 1.0, 3.0], "zeros": [0.0, 0.0],
}


@pytest.mark.parametrize("name", TOTALS)
def test_totals_are_exact_in_any_order(spark, name):
    values = TOTALS[name]
    want = math.fsum(values)
    for parts in (1, 7):
        shuffled = random.Random(parts).sample(values, len(values))
        r = analysis._measures(spark.createDataFrame([(v,) for v in shuffled], "x double").repartition(parts), ["x"]).first()
        assert abs(r["total"] - want) <= math.ulp(want) and r["mean"] == r["total"] / len(values)
        assert (r["n"], r["least"], r["most"]) == (len(values), min(values), max(values))


def test_totals_of_values_that_are_not_finite(spark):
    df = spark.createDataFrame([(1.0, math.nan, 1e308, None, "1.2万"), (math.inf, 2.0, 1e308, None, "(567)"), (3.0, 3.0, 1.0, None, None)], "a double, b double, c double, d double, e string")
    r = {r["field"]: r["total"] for r in analysis.numeric_summary(df, list("abcde")).collect()}
    assert r["a"] == math.inf and math.isnan(r["b"]) and r["c"] == math.inf and r["e"] == 11433 and set(r) == set("abce")


def test_two_decimals_equal_printf(spark):
    ties = [0.125, 0.375, -0.125, 2.675, 1.005, 0.005, 0.015, -0.001, 0.995, 0.999, 9.995, 446787.005, 220733.34499999999, 1e15 / 7, 2.0**52 + 0.5, 2.0**53, 1e17, 0.0, -0.0, 5e-324, 0.0625, 1.0]
    values = ties + [rnd.choice([1, -1]) * (rnd.randrange(10 ** rnd.randrange(1, 10)) + 0.5) / 100 for _ in range(3000)] + [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-4, 14) for _ in range(3000)]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(1).orderBy("i").select(analysis._two_decimals(F.col("x")).alias("t")).collect()]
    assert got == [f"{v:.2f}" for v in values]
    assert got == [r[0] for r in duckdb.execute("SELECT printf('%.2f', x) FROM (SELECT unnest(?) AS x)", [values]).fetchall()]


def test_sentences_round_once(spark):
    """A mean a little below a half, a half itself, and a total that all but cancels."""
    said = lambda *v: [r["finding"] for r in analysis.analyse(rules.apply_rules(spark.createDataFrame(list(enumerate(v)), "id int, x double"), []), "id", measures=["x"])["findings"].where("topic = 'numbers'").collect()]
    assert said(0.344998, 0.344999) == ["x: 2 numbers from 0.34 to 0.34, total 0.69, mean 0.34, nine in ten up to 0.34"]
    assert said(0.125, 0.125) == ["x: 2 numbers from 0.12 to 0.12, total 0.25, mean 0.12, nine in ten up to 0.12"]
    assert "total 1.10, mean 0.28," in said(1e16, 1.0, -1e16, 0.1)[0]
