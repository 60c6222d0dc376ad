"""States of profiles: made by part, stored, united."""

import random

from loamwork.operators import states


def test_united_states_equal_those_of_the_whole(spark, tmp_path):
    r = random.Random(2)
    data = [(i, f"d{r.randrange(4)}" if i % 9 else None, r.choice([None, "", " ", f"v{r.randrange(900)}"]), r.random() if i % 7 else None, str(r.randrange(5000))) for i in range(8000)]
    df = spark.createDataFrame(data, "id long, day string, v string, x double, n string").repartition(7)
    states.profile_states(df, "day", ["id"]).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert stored.count() == 5 * 5
    one = {x["column"]: x for x in states.profile_of(states.unite(stored, "all"), "t").collect()}
    days = sorted({d for _, d, *_ in data}, key=lambda d: (d is not None, d))
    for at, name in enumerate(df.columns):
        values = [row[at] for row in data]
        shown = one[name]
        assert (shown["part"], shown["rows"], shown["nulls"]) == ("all", 8000, sum(v is None for v in values))
        assert shown["empty_strings"] == sum(v is not None and not str(v).strip() for v in values)
        distinct = len({v for v in values if v is not None})
        assert abs(shown["distinct_values"] - distinct) <= 4 * states.DISTINCT_ERROR * distinct
        want = [str(row[at]) for d in days for row in data if row[1] == d and row[at] is not None]
        assert shown["samples"] == want[:3] or name == "x"
        if name in ("id", "x", "n"):
            numbers = sorted(float(v) for v in values if v is not None)
            assert (shown["numbers"], shown["least"], shown["most"]) == (len(numbers), numbers[0], numbers[-1])
            assert abs(shown["mean"] - sum(numbers) / len(numbers)) < 1e-6
            for q, v in zip((0.25, 0.5, 0.75), shown["quantiles"]):
                below, upto = sum(x < v for x in numbers) / len(numbers), sum(x <= v for x in numbers) / len(numbers)
                assert below - 2 * states.RANK_ERROR <= q <= upto + 2 * states.RANK_ERROR
    assert one["v"]["quantiles"] is None and one["v"]["mean"] is None


def test_states_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, float("nan"))], "id int, v string, `a.b` double")
    got = {x["column"]: x for x in states.profile_of(states.profile_states(df, "v", ["id"])).collect()}
    assert got["v"]["samples"] == [] and got["v"]["distinct_values"] == 0 and got["v"]["part"] is None
    assert got["a.b"]["numbers"] == 0 and got["a.b"]["quantiles"] is None and got["id"]["quantiles"] == [1.0, 1.0, 1.0]
    assert states.profile_states(df.limit(0), "v", ["id"]).count() == 0 and states.unite(states.profile_states(df.limit(0), "v", ["id"])).count() == 0
