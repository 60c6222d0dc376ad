"""Previews of rules against plain Python, and the sentences drawn from tables that have ties or no rows."""

import random

import pytest
from loamwork.operators import analysis, impact, rules
from loamwork.operators.rules import Rule

RULES = [
    Rule("a", "x", "is_blank", reason="one", severity="warn"),
    Rule("b", "y", "gt", 5, reason="one", severity="error"),
    Rule("c", "x", "duplicated", reason="two", severity="info"),
    Rule("d", "y", "lt", -100, severity="warn"),
]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", "", None, f"v{i}"]), float(rnd.randrange(10)), "z") for i in range(300)]
    return rows, spark.createDataFrame(rows, "id int, x string, y double, _t string").repartition(7)


def expected(rows):
    seen = {}
    for r in rows:
        seen[r[1]] = seen.get(r[1], 0) + 1
    return [lambda r: not (r[1] or "").strip(), lambda r: r[2] > 5, lambda r: seen[r[1]] > 1, lambda r: r[2] < -100]


def test_impact_equals_plain_python(table):
    rows, df = table
    a, b, c, d = expected(rows)
    got = {(r["part"], r["name"]): r for r in impact.impact(df, RULES, ["id"], samples=4).collect()}
    assert set(got) == {("rule", "a"), ("rule", "b"), ("rule", "c"), ("rule", "d"), ("label", "one"), ("label", "two"), ("label", "d")}
    either = lambda r: a(r) or b(r)
    for key, test in {("rule", "a"): a, ("rule", "b"): b, ("rule", "c"): c, ("rule", "d"): d, ("label", "one"): either, ("label", "two"): c}.items():
        ids = [r[0] for r in rows if test(r)]
        assert got[key]["rows"] == len(ids) and got[key]["rate"] == round(len(ids) / 300, 4)
        assert got[key]["sample_keys"] == [str(i) for i in ids[:4]]  # in the order of the key, not of its text
    assert got["label", "one"]["hits"] == sum(map(a, rows)) + sum(map(b, rows)) > got["label", "one"]["rows"]
    assert got["label", "one"]["severity"] == "error" and got["label", "one"]["rules"] == 2
    assert got["label", "one"]["condition"] == "x is_blank; y gt 5"


def test_labelled_rows_and_approval(table):
    rows, df = table
    a, b, c, d = expected(rows)
    found = impact.labelled_rows(df, RULES, ["id"], most=15)
    assert found.columns == ["labels", "id", "x", "y", "_t"]
    told = lambda r: ";".join((["one"] if a(r) or b(r) else []) + (["two"] if c(r) else []))
    assert [(r["labels"], r["id"]) for r in found.collect()] == [(told(r), r[0]) for r in rows if told(r)][:15]
    items = {r["item"]: r["count"] for r in impact.approval_list(df, RULES, 2).collect()}
    assert items == {"lookups": 2, "rules": 4, "labels": 3, "rows": 300, "labelled rows": sum(bool(told(r)) for r in rows), "rows with errors": sum(map(b, rows))}


def test_previews_of_empty_tables_and_of_no_rules(spark, table):
    none = table[1].where("false")
    got = impact.impact(none, RULES, ["id"]).collect()
    assert len(got) == 7 and all(r["rows"] == 0 and r["rate"] == 0 and r["sample_keys"] == [] for r in got)
    assert impact.labelled_rows(none, RULES, ["id"]).count() == 0
    assert impact.impact(table[1], [], ["id"]).count() == 0 == impact.labelled_rows(table[1], [], ["id"]).count()
    assert {r["item"]: r["rate"] for r in impact.approval_list(none, RULES).collect()}["labelled rows"] == 0
    clash = table[1].withColumnRenamed("_t", "labels")
    assert impact.labelled_rows(clash, RULES, ["id"], most=3).columns == ["labels", "id", "x", "y"]
    with pytest.raises(ValueError):
        impact.impact(table[1], RULES, [])


def test_samples_are_cut_before_rows_move(table):
    plan = impact.impact(table[1], RULES[:2], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Scan ExistingRDD") == 2


def test_findings_of_ties_and_empty_tables(spark):
    df = rules.apply_rules(spark.createDataFrame([(i, g, m) for i, (g, m) in enumerate([("b", "2024-01"), ("a", "2024-01"), ("b", "2024-02"), ("a", "2024-02")])], "id int, grp string, month string"), [Rule("r", "grp", "equals", "a", reason="bad")])
    told = {r["topic"]: r["finding"] for r in analysis.analyse(df, "grp", dimension="grp", date="month", measures=["id"], points=("id", "id"), order_by=["id"])["findings"].where("topic <> 'status'").collect()}
    assert told["groups"] == "grp is most often a: 2 rows"
    assert told["trend"] == "the last month, 2024-02, has 2 rows; most, 2, are in 2024-01"
    assert told["cross"] == "a has most rows with bad: 2"
    assert told["counts"] == "of 4 rows 2 are usable (50.0 %) and 2 need review (50.0 %)"
    assert "missing" not in told
    none = analysis.analyse(df.where("false"), "grp", dimension="grp", date="month")["findings"].collect()
    assert [(r["topic"], r["finding"]) for r in none] == [("counts", "of 0 rows 0 are usable (0.0 %) and 0 need review (0.0 %)")]
