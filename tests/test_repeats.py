from loamwork.functions.repeats import mark_many, mark_repeats, row_cells
from loamwork.operators import detect
from pyspark.sql import functions as F


def plan(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text.count("Relation ["), text.count("Join ")


def test_the_plan_does_not_grow_with_the_keys(spark):
    df = spark.createDataFrame([(i, i % 3, i % 5, None if i % 2 else i % 4) for i in range(40)], "a int, b int, c int, d int")
    plans = {n: plan(mark_many(df, {f"r{i}": [F.col("abcd"[i % 4])] for i in range(n)})) for n in (1, 2, 8, 70)}
    assert len(set(plans.values())) == 1, plans
    assert plan(detect.detect(df.toDF("a_id", "b_id", "c_id", "d_id")))[1] == plans[8][1]


def test_many_equal_one(spark):
    df = spark.createDataFrame([(i, i % 7 if i % 3 else None, "x" if i % 9 else f"v{i}", [i % 2]) for i in range(60)], "a int, b int, c string, d array<int>")
    names = {"ra": ["a"], "rb": ["b"], "rc": ["c"], "rbc": ["b", "c"], "rd": ["d"]}
    many = mark_many(df, {k: row_cells(df, v) for k, v in names.items()})
    for k, v in names.items():
        one = mark_repeats(df, row_cells(df, v), k)
        assert sorted((r["a"], r[k]) for r in many.collect()) == sorted((r["a"], r[k]) for r in one.collect())


def test_maps_count_as_values(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (2, {"a": 1}), (2, None)], "id int, m map<string,int>")
    out = detect.detect(df, keys=[])
    assert sorted(r["id"] for r in out.where(detect.any_finding("duplicate_row")).collect()) == [1, 1]


def test_known_values(spark):
    df = spark.createDataFrame([("a",), ("B",), (None,)], "v string")
    got = mark_many(df, {}, {"hit": (F.lower("v"), spark.createDataFrame([("b",), ("b",)], "low string"))})
    assert sorted((r["v"] or "", r["hit"]) for r in got.collect()) == [("", False), ("B", True), ("a", False)]


def test_repeats_need_no_second_look_at_the_rows(spark):
    """One count tells which rows are alone; the rows themselves are joined once, with the bits of each."""
    df = spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("a"))
    marked = mark_many(df, {"again": [F.col("a")], "id_again": [F.col("id")]})
    assert plan(marked)[1] == 1
    assert marked.where("again and not id_again").count() == 40


def test_only_wanted_issues_are_looked_for(spark):
    df = spark.createDataFrame([(1, " x", -5.0), (1, " x", -5.0), (2, "", 7.0), (None, "", 7.0)], "row_id long, name string, amount double")
    kept = lambda d: sorted(str([f for f in r["findings"] if f["issue"] in ("duplicate_key", "duplicate_row")]) for r in d.collect())
    some, every = detect.detect(df, issues=("duplicate_key", "duplicate_row")), detect.detect(df)
    assert {f["issue"] for r in some.collect() for f in r["findings"]} == {"duplicate_key", "duplicate_row"}
    assert kept(some) == kept(every)
