import random

import numpy as np
import pytest
from loamwork.operators import rows, segments, summarize
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables keep all their ranges, so that carries are met."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows in one partition; nulls in keys, values and sources."""
    rng = random.Random(8)
    made = [(i, "hot" if i % 2 else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, None, f"v{i}"])) for i in range(4000)]
    return spark.createDataFrame(made, "id long, k string, x int, v string").repartition(7)


def test_ranks_in_a_hot_partition(hot):
    got = rows.dense_rank(hot, "r", "x", ["k"]).toPandas()
    want = got.groupby("k", dropna=False)["x"].rank("dense", ascending=False)
    assert len(got) == 4000 and (got["r"].fillna(-1) == want.fillna(-1)).all()


def test_fill_in_a_hot_partition(hot):
    got = rows.fill_down(hot, "f", "v", ["id"], ["k"]).toPandas().sort_values("id")
    want = got.groupby("k", dropna=False)["v"].ffill()
    assert len(got) == 4000 and (got["f"].fillna("-") == want.fillna("-")).all()


def test_a_hot_partition_is_spread_over_ranges(spark, hot):
    out = segments.running_sum(hot, ["k"], [F.col("id")], F.lit(1), "n")
    hot_rows = out.where("k = 'hot'").toPandas().sort_values("id")
    assert hot_rows["n"].tolist() == list(range(1, 2001))
    ranges = hot.repartitionByRange("k", "id").where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges >= 3


@pytest.mark.parametrize("most", [3, 50_000])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), [1e300, -1e300]])
    df = spark.createDataFrame([(float(v), int(i % 5), None) for i, v in enumerate(x)], "x double, y int, z double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 0.9999, 1.0]
    got = segments.exact_quantiles(df, {c: F.col(c) for c in "xyz"}, ps, accuracy=100, most=most)
    assert got["x"] == pytest.approx(np.quantile(x, ps).tolist()) and got["y"] == pytest.approx(np.quantile(np.arange(len(x)) % 5, ps).tolist()) and got["z"] == [None] * len(ps)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 150])
def test_exact_quantiles_of_few_values(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    got = segments.exact_quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), {"x": F.col("x")}, [0.25, 0.5, 0.75, 0.9])
    assert got["x"] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75, 0.9]).tolist())


def test_medians_by_group_and_in_all(hot):
    got = {r["k"]: (r["n"], r["m"]) for r in summarize.aggregate(hot, ["k"], [summarize.Metric("count", output="n"), summarize.Metric("median", "x", "m")]).collect()}
    want = hot.toPandas().groupby("k", dropna=False)["x"].agg(["size", "median"])
    assert got == {(None if k != k else k): (int(a), b) for k, (a, b) in zip(want.index, want.to_numpy())}
    plan = summarize.aggregate(hot, ["k"], [summarize.Metric("median", "x", "m")])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan
    assert [r["m"] for r in summarize.aggregate(hot, [], [summarize.Metric("median", "x", "m")]).collect()] == [hot.toPandas()["x"].median()]
