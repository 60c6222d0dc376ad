import warnings
from difflib import SequenceMatcher

import pytest
from loamwork.functions.formulas import Formula
from loamwork.functions.predicates import Condition
from loamwork.operators import audit, detect, lookup, profile, reshape, rows, rules, summarize
from loamwork.plans import pipeline
from pyspark.sql import functions as F


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([("O1", "C1", "100"), ("O2", " c2 ", "1,234"), ("O3", "C404", "(50)"), ("O4", None, "x"), ("O5", "", "7")], "order_id string, customer_id string, amount string")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([("C1", "Ann", 1), ("C2", "Bob", 2), ("C2", "Bea", 3), ("C3", None, 4)], "customer_id string, name string, n int")


@pytest.mark.parametrize("mode", ["exact", "trim", "case_insensitive", "normalized_exact", "fuzzy"])
@pytest.mark.parametrize("policy", ["first", "list", "aggregate", "review"])
def test_lookups_keep_every_row(orders, customers, mode, policy):
    out = lookup.lookup(orders, customers, "customer_id", "customer_id", ["name", "n"], mode=mode, policy=policy, order_by=["n"], match_field="found", explanation_field="why")
    assert out.count() == orders.count()
    found = {r["order_id"]: (r["name"], r["n"], r["found"]) for r in out.collect()}
    assert found["O1"][2] and not found["O4"][2] and not found["O5"][2] and found["O3"][2] == (mode == "fuzzy" and False)
    if mode == "normalized_exact":
        assert found["O2"] == {"first": ("Bob", 2, True), "list": ("Bob; Bea", "2; 3", True), "aggregate": ("Bob; Bea", 5.0, True), "review": ("Bob", 2, True)}[policy]


@pytest.mark.parametrize("mode", ["exact", "fuzzy"])
def test_blank_keys_do_not_meet_in_one_task(spark, mode):
    """Rows without a partner are dealt out like others, are told apart from those with one, and match no odd key."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    key = F.when(F.col("id") % 4 == 0, F.concat(F.lit("key number "), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, " \t ")
    left = spark.range(0, 4000, 1, 64).withColumn("k", key)
    right = spark.createDataFrame([("key number 0", 1), (" \t", 2), ("", 3), (None, 4)], "k string, n int")
    out = lookup.lookup(left, right, "k", "k", ["n"], mode=mode, threshold=0.99, order_by=["n"], match_field="found", explanation_field="why")
    rows = out.select("id", "n", "found", "why", F.spark_partition_id().alias("part")).collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert len({r["id"] for r in rows}) == len(rows) == 4000
    assert [(r["id"], r["n"]) for r in rows if r["found"]] == [(0, 1)] and {r["id"] % 4 for r in rows if r["why"] == "blank key"} == {1, 2, 3}
    assert sum(r["why"] == "blank key" for r in rows) == 3000
    blank = [r["part"] for r in rows if r["why"] == "blank key"]
    assert max(blank.count(p) for p in set(blank)) < 1500


def test_lookup_errors(orders, customers):
    with pytest.raises(lookup.DuplicateKeys, match="C2"):
        lookup.lookup(orders, customers, "customer_id", "customer_id", ["name"], policy="error", order_by=["n"])
    with pytest.raises(ValueError, match="order"):
        lookup.lookup(orders, customers, "customer_id", "customer_id", ["name"])


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.85, 0.95])
def test_fuzzy_equals_brute_force(spark, threshold):
    left = ["apple juice", "appel juice", "banana bread", "bananna brd", "x", "ab", "ba", "orange", None, "", "grape soda 1l"]
    right = ["apple juice", "banana bread", "oranges", "orangina", "abc", "grape soda 2l", "x", "cab", ""]
    got = lookup.fuzzy_matches(spark.createDataFrame([(x,) for x in left if x], "_key string"), spark.createDataFrame([(x,) for x in right if x], "_key string"), threshold)
    want = []
    for a in {x for x in left if x}:
        best = max(((SequenceMatcher(None, a, b).ratio() if a != b else 1.0), b) for b in right if b)[0]
        if best >= threshold:
            want.append((a, min(b for b in right if b and (1.0 if a == b else SequenceMatcher(None, a, b).ratio()) == best), round(best, 9)))
    assert sorted((r["left_key"], r["right_key"], round(r["score"], 9)) for r in got.collect()) == sorted(want)


def test_rollup_fills_and_keeps_rows(spark):
    master = spark.createDataFrame([("C1",), ("C2",), ("C3",), (None,)], "k string")
    detail = spark.createDataFrame([("C1", "1,234"), ("C1", "(200)"), ("C2", "500"), ("C2", "300")], "k string, amount string")
    assert values(lookup.rollup(master, detail, "k", "k", summarize.Metric("sum", "amount", "total")), "k", "total") == sorted([("C1", 1034.0), ("C2", 800.0), ("C3", 0.0), (None, 0.0)], key=repr)


def test_order_is_asked_for(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        rows.dedupe(df, ["k"])
    assert values(rows.dedupe(df, ["k"], "first", ["v"]), "v") == [(1,)] and values(rows.dedupe(df, ["k"], "last", ["v"]), "v") == [(2,)]


def test_fill_down_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 900 == 5, F.col("id")).alias("v"))
    got = dict(values(rows.fill_down(df, "o", "v", ["id"]), "id", "o"))
    assert all(got[i] == ((i - 5) // 900 * 900 + 5 if i >= 5 else None) for i in range(5000))


def test_dense_rank_has_no_single_partition(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 37).alias("v"))
    out = rows.dense_rank(df, "r", "v", as_type="number")
    assert all(r["r"] == 37 - r["v"] for r in out.collect())
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_optional_formulas_are_left_out(spark):
    df = spark.createDataFrame([("1",)], "a string")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = rows.apply_formulas(df, [Formula("b", "trim", "a"), Formula("c", "trim", "zz", required=False), Formula("d", "concat", columns=["a", "b"])])
    assert out.columns == ["a", "b", "d"] and len(seen) == 1
    with pytest.raises(ValueError):
        rows.apply_formulas(df, [Formula("c", "trim", "zz")])


def test_crosstab(spark):
    df = spark.createDataFrame([("A", "1", "1,000"), ("A", "2", "5"), ("B", "1", "(3)"), (None, "1", "9"), ("B", None, "9")], "city string, month string, amount string")
    assert values(summarize.crosstab(df, ["city"], "month", summarize.Metric("sum", "amount")), "city", "1", "2") == [("A", 1000.0, 5.0), ("B", -3.0, 0.0)]
    with pytest.raises(ValueError):
        summarize.crosstab(df, ["city"], "month", summarize.Metric("count"), max_values=1)


def test_reshape_helpers(spark):
    wide = spark.createDataFrame([("x", 1, 2, None)], "name string, m1 int, m2 int, m3 int")
    assert reshape.wide_columns(wide) == ["m1", "m2", "m3"] and reshape.unpivot(wide, ["m1", "m2", "m3"], "m", "v").count() == 3
    parts = spark.createDataFrame([("a-b-c",), ("d-e-f",), (None,)], "v string")
    assert reshape.infer_separator(parts, "v") == ("-", 3)
    assert values(reshape.split_column(parts, "v", "-", 3), "v_1", "v_3") == sorted([("a", "c"), ("d", "f"), ("", "")])
    assert reshape.template_schema({"t": parts.limit(0).select("v", F.lit("").alias("w")), "p": parts}) == ["v", "w"]
    assert reshape.unionable({"a": parts, "b": parts, "c": wide}) == [["a", "b"]]
    masked = spark.createDataFrame([("Ann", "write to a.b@c.org", "12345678")], "name string, note string, n string")
    assert values(reshape.mask_sensitive(masked), "name", "note", "n") == [("<text:length=3,letters=3,digits=0>", "<text:length=18,letters=13,digits=0>", "<digits:length=8>")]
    risky = spark.createDataFrame([("=2+2",), ("-50",), ("@x",), ("＝1",), ("ok",)], "v string")
    assert values(reshape.neutralize_formulas(risky), "v") == sorted([("'=2+2",), ("-50",), ("'@x",), ("'＝1",), ("ok",)], key=repr)


def test_fixes_are_idempotent(spark):
    df = spark.createDataFrame([(1, " Ａ​b "), (2, "ok"), (3, None)], "id int, v string")
    once = detect.auto_fix(df)
    assert values(once, "id", "v") == [(1, "Ab"), (2, "ok"), (3, None)] and values(detect.auto_fix(once), "v") == values(once, "v")
    assert values(detect.fix_audit(df, ["id"]), "id", "field", "after") == [(1, "v", "Ab")] and detect.fix_audit(once, ["id"]).count() == 0


def test_detectors_name_columns():
    assert detect.column_name_findings(["a", "a", "Unnamed: 2", " "]) == [("a", "duplicate_columns"), ("Unnamed: 2", "unnamed_column"), (" ", "unnamed_column")]


def test_rules_split_and_scope(spark):
    df = spark.createDataFrame([("1", "a@b.c", "5"), ("", "bad", "500"), ("3", None, "x")], "id string, email string, risk string")
    made = rules.rules_from_json_schema('{"required": ["id"], "properties": {"email": {"format": "email"}, "risk": {"type": "number", "maximum": 100}, "id": {"type": "string"}}}')
    out = rules.apply_rules(df, made)
    usable, review = rules.split_usable(out)
    assert usable.count() + review.count() == 3 and values(usable, "id") == [("1",)]
    assert values(out, "id") == values(df, "id")
    assert rules.split_usable(out, kinds=["missing"])[1].count() == 1 and rules.split_usable(out, kinds=[])[1].count() == 0
    weak, strong = rules.Rule("a", "id", "is_blank", severity="warn"), rules.Rule("b", "id", "is_blank", severity="error")
    assert rules.merge_rules([weak, strong]) == [strong]


def test_extract_rules(spark):
    docs = spark.createDataFrame([("amount 必填\nstatus 允许值: open, closed\namount >= 0\nemail 邮箱格式\n| amount | required | at most 100 |",)], "text string")
    got = values(rules.extract_rules(docs, ["amount", "status", "email"]), "field", "kind", "value")
    assert got == sorted([("amount", "required", ""), ("status", "allowed", "open,closed"), ("amount", "min", "0"), ("email", "email", ""), ("amount", "max", "100")])
    assert {r.op for r in rules.rules_from_rows([dict(zip(("field", "kind", "value"), g)) for g in got])} == {"is_blank", "not_in", "lt", "gt", "regex_not_match"}


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    audit.assert_contract(df, audit.Contract(["k", "v"], rows=2))
    for bad in (audit.Contract(["v", "k"]), audit.Contract(["k"], "exact"), audit.Contract(["z"], "subset"), audit.Contract(rows=3), audit.Contract(unique=["k"])):
        with pytest.raises(audit.ContractBroken):
            audit.assert_contract(df, bad)
    with pytest.raises(audit.ContractBroken):
        audit.assert_artifacts({"a": df}, {"b": audit.Contract()})


def test_guard(spark):
    df = spark.range(100)
    assert profile.guard_removal(df, df.where("id >= 10")) == (100, 10)
    with pytest.raises(profile.RemovalNotConfirmed):
        profile.guard_removal(df, df.where("id >= 25"))
    assert profile.guard_removal(df, df.where("id >= 99"), confirmed=True) == (100, 99)


def test_observed_counts_take_no_pass(spark):
    df, seen = audit.observed(spark.range(50), "step", even=F.count(F.when(F.col("id") % 2 == 0, 1)))
    assert df.count() == 50 and seen.get == {"rows": 50, "even": 25}


def test_job_end_to_end(spark, orders, customers):
    one = customers.dropDuplicates(["customer_id"])
    job = pipeline.Job(
        "orders", lookups=[pipeline.LookupStep("customers", "customer_id", "customer_id", ["name"], {"mode": "normalized_exact", "order_by": ["n"]})],
        formulas=[Formula("big", "if_else", conditions=[Condition("amount", "gt", 50)], true_value="yes", false_value="no")], detect=False,
        rules=[rules.Rule("customer known", "customers_matched", "lookup_missing", reason="customer_not_found")], group_by=["big"], metrics=[summarize.Metric("sum", "amount", "total")],
    )
    r = pipeline.run(job, {"orders": orders, "customers": one})
    assert r.detail.count() == 5 and values(r.usable, "order_id") == [("O1",), ("O2",)] and r.review.count() == 3
    assert values(r.summary, "big", "total") == [("no", 1234.0), ("yes", 100.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "order_id string, amount string, order_date string")
    assert profile.profile(none).count() == 3 and detect.detect(none).count() == 0 and summarize.aggregate(none, ["order_id"], [summarize.Metric("sum", "amount")]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_structure_findings(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, a string, b string").toDF("id", "v", "v")
    found = detect.issue_summary(detect.detect(df, keys=[]), columns=[*df.columns, "Unnamed: 3"])
    assert values(found, "field", "issue", "affected_rows") == [("Unnamed: 3", "unnamed_column", 1), ("v", "duplicate_columns", 2)]
    empty = spark.createDataFrame([], "id long, v string")
    assert values(detect.issue_summary(detect.detect(empty, keys=[])), "field", "issue", "affected_rows") == [("", "empty_table", 0)]


def test_cell_findings(spark):
    rows_ = [(1, "Ann", "5", "2024-01-01"), (2, "ANN", "-2", "2024/01/02"), (3, "b​ob", None, "soon"), (4, "Eve", "7", None), (5, "eve ", "9", "2024-01-03")]
    df = spark.createDataFrame(rows_, "id long, name string, qty string, day string")
    got = detect.detect(df, keys=["name"]).select("id", F.explode("findings").alias("f")).select("id", "f.field", "f.issue")
    assert values(got, "id", "field", "issue") == sorted([
        (1, "name", "mixed_case_duplicates"), (2, "name", "mixed_case_duplicates"), (4, "name", "mixed_case_duplicates"), (5, "name", "mixed_case_duplicates"), (5, "name", "outer_spaces"),
        (3, "name", "invisible_characters"), (3, "qty", "null_value"), (4, "day", "null_value"), (3, "day", "date_parse_failed"), (2, "qty", "negative_numeric_value"),
        *[(i, "qty", "number_as_text") for i in (1, 2, 4, 5)], *[(i, "day", "mixed_date_formats") for i in (1, 2, 3, 5)],
    ], key=repr)


def test_repeats_need_no_window(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, "x"), (1, "a", None), (5, "", "y")], "id long, k string, v string")
    out = detect.detect(df, keys=["k"])
    assert values(out.where(detect.any_finding("duplicate_key")), "id") == [(1,), (1,), (2,)] and values(out.where(detect.any_finding("duplicate_row")), "id") == [(1,), (1,)]
    twice = rows.dedupe(df, ["k"], "all_duplicates")
    assert values(twice, "id") == [(1,), (1,), (2,), (3,), (4,)]
    ruled = rules.apply_rules(df, [rules.Rule("k twice", "k", "duplicated", reason="twice")])
    assert values(ruled.where(F.size("issues") > 0), "id") == values(twice, "id") and ruled.columns == ["id", "k", "v", "issues"]
    for d in (out, twice, ruled):
        assert "Window" not in plan_of(d)


def test_profile_equals_brute_force(spark):
    data = [(1, "a"), (1, None), (2, " "), (None, "a"), (3, "b"), (None, "c")]
    df = spark.createDataFrame(data, "n long, s string")
    got = {r["column"]: r for r in profile.profile(df, "t").collect()}
    assert tuple(got["n"])[:9] == ("t", "n", "bigint", 6, 2, round(2 / 6, 6), 0, 3, 4) and got["n"]["samples"] == ["1", "2", "3"]
    assert tuple(got["s"])[:9] == ("t", "s", "string", 6, 1, round(1 / 6, 6), 1, 4, 2) and got["s"]["samples"] == [" ", "a", "b"]
    empty = {r["column"]: (r["rows"], r["nulls"], r["distinct_values"]) for r in profile.profile(df.limit(0)).collect()}
    assert empty == {"n": (0, 0, 0), "s": (0, 0, 0)}
    rough = {r["column"]: r for r in profile.profile(df, approx=True).collect()}
    assert rough["n"]["distinct_values"] == 3 and rough["s"]["samples"] == [" ", "c"]


def test_decisions_and_labels(spark):
    df = rules.apply_rules(spark.createDataFrame([(i, None if i % 3 else "x") for i in range(9)], "id long, v string"), [rules.Rule("v", "v", "is_blank", reason="blank")])
    decided = spark.createDataFrame([(1, "accept"), (1, "pending"), (2, "accept"), (2, "exclude"), (4, "pending")], "id long, decision string")
    kept, held = audit.apply_decisions(df, decided, ["id"])
    assert values(kept, "id") == [(0,), (1,), (3,), (6,)] and held.count() == 5
    assert values(audit.label_summary(df, ["id"], 2), "reason", "rows", "samples") == [("blank", 6, "1,2")]
    hits = profile.rule_impact(df.drop("issues"), [rules.Rule("v", "v", "is_blank", reason="blank")], ["id"])
    assert values(hits, "reason", "hits", "sample_key") == [("blank", 6, "1")]


def test_template_requirements():
    inventory = [{"table": "import_orders", "file": "/in/a.csv", "file_name": "a.csv"}, {"table": "orders", "file": "/in/b.csv", "file_name": "b.csv"}, {"table": "t", "file": "/in/客户模板.csv", "file_name": "客户模板.csv"}]
    found = rules.template_requirements({"import_orders": ["id", "city"], "orders": ["x"], "t": ["姓名"]}, inventory)
    assert [(r["source_file"], r["field"]) for r in found] == [("/in/a.csv", "id"), ("/in/a.csv", "city"), ("/in/客户模板.csv", "姓名")]


def test_large_value_maps_keep_rows(spark):
    df = spark.createDataFrame([("1",), ("7",), (None,)], "v string")
    many = {i: f"n{i}" for i in range(2, 700)} | {1: "one", "1": "uno"}
    assert values(reshape.map_values(df, "v", many), "v_mapped") == sorted([("uno",), ("n7",), (None,)], key=repr)


def test_lookups_take_any_column_name(spark):
    left = spark.createDataFrame([("a", 1, 2, 3)], "_key string, _n int, score int, _f0 int")
    right = spark.createDataFrame([("a", 7, 8)], "k string, _n int, v int")
    for mode in ("exact", "fuzzy"):
        out = lookup.lookup(left, right, "_key", "k", ["_n", "v"], mode=mode, order_by=["v"], match_field="found")
        assert out.columns == ["_key", "_n", "score", "_f0", "_n_lookup", "v", "found"] and [tuple(r) for r in out.collect()] == [("a", 1, 2, 3, 7, 8, True)]


def test_a_job_sums_by_columns_outside_its_target(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, "y", 7.0)], "id int, g string, v double")
    done = pipeline.run(pipeline.Job("t", auto_fix=False, detect=False, target_schema=["id"], group_by=["g"], metrics=[summarize.Metric("sum", "v", "s")]), {"t": df})
    assert values(done.summary, "g", "s") == [("x", 5.0), ("y", 7.0)] and done.usable.columns == ["id"]
    told = done.measured(lambda d: d.collect())
    assert values(told, "step", "rows_in", "rows_out", "flagged") == sorted([("source", 2, 2, None), ("formulas", 2, 2, None), ("rules", 2, 2, 0)], key=repr)
