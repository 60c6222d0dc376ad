"""Queries over names, notices, formats, drafts of plans, reviews and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formulas import Formula
from ..functions.predicates import Condition, remark_row, sparse_note_row, total_row
from ..functions.text import parse_business_number
from ..operators import audit, detect, lookup, profile, reshape, rows, rules, summarize
from ..operators.rules import Rule
from ..plans import pipeline
from ..sources import tables
from ..sources.scratch import scratch_dir
from .base import registry
from .checks import _A, _C, _D, _S, RULES, bad_orders, ruled

REGISTERED, query = registry()

_NAMES = "CASE s_suppkey % 9 WHEN 0 THEN 'Summit ' || s_suppkey WHEN 1 THEN 'Total Energies' WHEN 2 THEN 'total' WHEN 3 THEN '小计' WHEN 4 THEN 'Notebook' WHEN 5 THEN 'Note: late' WHEN 6 THEN 'Sumitomo' ELSE s_name END"


def named(supplier):
    k = F.col("s_suppkey") % 9
    shown = (
        F.when(k == 0, F.concat(F.lit("Summit "), F.col("s_suppkey").cast("string"))).when(k == 1, "Total Energies").when(k == 2, "total").when(k == 3, "小计")
        .when(k == 4, "Notebook").when(k == 5, "Note: late").when(k == 6, "Sumitomo").otherwise(F.col("s_name"))
    )
    return supplier.select(shown.alias("name"), "s_suppkey", "s_acctbal")


@query("supplier", sql="SELECT s_suppkey, s_suppkey % 9 IN (2, 3) AS total, s_suppkey % 9 = 5 AS remark FROM supplier")
def total_and_remark_rows(supplier):
    t = named(supplier)
    return t.select("s_suppkey", total_row(["name"]).alias("total"), remark_row(["name"]).alias("remark"))


@query("supplier", sql=f"SELECT {_NAMES} AS name, count(*) AS rows, round(sum(s_acctbal), 2) AS balance FROM supplier WHERE s_suppkey % 9 NOT IN (2, 3) GROUP BY 1")
def summary_keeps_names_like_totals(supplier):
    out = summarize.summarize(named(supplier), ["name"], [summarize.Metric("count", output="rows"), summarize.Metric("sum", "s_acctbal", "balance")])
    return out.withColumn("balance", F.round("balance", 2))


@query("supplier", sql="SELECT s_suppkey, s_suppkey % 5 = 0 AS note FROM supplier")
def sparse_notes(supplier):
    note = F.when(F.col("s_suppkey") % 5 == 0, "see the other file").otherwise(F.col("s_name"))
    t = supplier.select("s_suppkey", note.alias("a"), *[F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey").cast("string")).alias(c) for c in "bc"])
    return t.select("s_suppkey", sparse_note_row(["a", "b", "c"]).alias("note"))


@query("orders", sql="SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day_first, strftime(o_orderdate, '%m-%d-%y') AS month_first, strftime(o_orderdate, '%Y.%m.%d') AS dotted, strftime(o_orderdate, '%Y年%m月%d日') AS written FROM orders")
def formulas_date_text(orders):
    t = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    made = [Formula("day_first", "text", "d", value="dd/mm/yyyy"), Formula("month_first", "text", "d", value="mm-dd-yy"), Formula("dotted", "text", "d", value="%Y.%m.%d"), Formula("written", "text", "d", value="yyyy年mm月dd日")]
    return rows.apply_formulas(t, made).drop("d")


@query("part", sql="SELECT p_partkey, p_size::DOUBLE * CASE p_partkey % 6 WHEN 4 THEN 1000 WHEN 5 THEN 10000 ELSE 1 END AS v FROM part")
def currency_words(part):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    t = F.when(k == 0, F.concat(n, F.lit("块"))).when(k == 1, F.concat(n, F.lit(" 人民币"))).when(k == 2, F.concat(n, F.lit("美元"))).when(k == 3, F.concat(F.lit("RMB "), n)).when(k == 4, F.concat(n, F.lit("千元"))).otherwise(F.concat(n, F.lit("万元")))
    return part.select("p_partkey", parse_business_number(t).alias("v"))


@query("part", sql="SELECT p_partkey, p_brand AS copied, 'fixed' AS literal, p_brand || '-' || p_type AS joined, p_size % 2 = 1 AS truthy, p_size % 2 = 0 AS untrue, TIMESTAMP '2024-05-06' AS today FROM part")
def formulas_plain(part):
    t = part.withColumn("yes", F.when(F.col("p_size") % 2 == 1, "Yes").otherwise("no"))
    made = [Formula("copied", "copy", "p_brand"), Formula("literal", "literal", value="fixed"), Formula("joined", "join", columns=["p_brand", "p_type"], sep="-"), Formula("truthy", "and", "yes"), Formula("untrue", "not", "yes"), Formula("today", "today", value="2024-05-06")]
    return rows.apply_formulas(t, made).select("p_partkey", *[f.output for f in made])


@query("customer", sql="SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def rename_columns(customer):
    return reshape.rename(customer, {"c_name": "name", "c_mktsegment": "segment"}).select("c_custkey", "name", "segment")


@query("customer", sql="SELECT c_mktsegment, c_custkey, c_name FROM customer")
def drop_technical(customer):
    t = customer.select("c_custkey", "c_name", "c_mktsegment", F.lit(1).alias("_row_id"), F.lit("x").alias("c_name_std"), F.lit(True).alias("is_active_now"), F.lit("k").alias("record_key"))
    return reshape.drop_technical(t, ["c_mktsegment"])


@query("nation", sql="SELECT n_name, replace(m, 'v', 'm') AS month, CASE m WHEN 'v1' THEN n_nationkey WHEN 'v2' THEN n_regionkey ELSE n_nationkey + n_regionkey END::BIGINT AS v FROM nation, (VALUES ('v1'), ('v2'), ('v3')) AS t(m)")
def wide_block(nation):
    t = nation.select("n_name", F.col("n_nationkey").cast("long").alias("m1"), F.col("n_regionkey").cast("long").alias("m2"), (F.col("n_nationkey") + F.col("n_regionkey")).cast("long").alias("m3"))
    return reshape.unpivot(t, reshape.wide_columns(t), "month", "v")


@query("part", sql="SELECT p_partkey, split_part(p_brand, '#', 1) AS word, split_part(p_brand, '#', 2) AS p_brand_2, '' AS p_brand_3 FROM part")
def split_with_names(part):
    return reshape.split_column(part.select("p_partkey", "p_brand"), "p_brand", "#", 3, reshape.split_names("p_brand", 3, ["word"])).drop("p_brand")


@query("nation", sql="SELECT n_name, n_nationkey::BIGINT AS source_row FROM nation")
def trace_and_simplify(nation):
    traced = reshape.trace(nation.select("n_name", F.col("n_nationkey").cast("long").alias("_row_id"), F.lit("x").alias("_lookup_note")), "nation")
    return reshape.simplify(traced).select("n_name", "source_row")


@query("orders", "customer", sql="SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_unique_or_error(orders, customer):
    return lookup.lookup(orders, customer, "o_custkey", "c_custkey", ["c_name"], policy="error", order_by=["c_custkey"]).select("o_orderkey", "c_name")


@query("supplier", sql="SELECT s_suppkey, s_suppkey AS found, true AS matched FROM supplier")
def lookup_fuzzy_codes(supplier):
    """Codes with one character changed and one added: the true code is the only one within the threshold."""
    code = F.concat(F.lit("supplier code "), F.regexp_replace(F.md5(F.col("s_suppkey").cast("string")), "[0-9]", "x"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.md5(F.concat(F.lit("b"), F.col("s_suppkey").cast("string"))))
    true = supplier.select(F.col("s_suppkey").alias("found"), code.alias("code"))
    typed = supplier.select("s_suppkey", F.concat(F.lit("Supplier_code "), F.substring(code, 15, 100), F.lit("!")).alias("typed"))
    return lookup.lookup(typed, true, "typed", "code", ["found"], mode="fuzzy", order_by=["found"], match_field="matched").select("s_suppkey", "found", "matched")


@query("orders", "customer", sql="""
SELECT 1 AS place, 'source' AS step, count(*) AS rows_in, count(*) AS rows_out, 0::BIGINT AS removed, NULL::BIGINT AS matched, NULL::BIGINT AS flagged FROM orders
UNION ALL SELECT 2, 'lookup customer', count(*), count(*), 0, count(CASE WHEN o_custkey % 3 > 0 THEN 1 END), NULL FROM orders
UNION ALL SELECT 3, 'formulas', count(*), count(CASE WHEN o_totalprice >= 50000 THEN 1 END), count(CASE WHEN NOT o_totalprice >= 50000 THEN 1 END), NULL, NULL FROM orders
UNION ALL SELECT 4, 'rules', count(*), count(*), 0, NULL, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) FROM orders WHERE o_totalprice >= 50000""")
def stage_metrics(orders, customer):
    """Rows in and out of each step of a job, with matches, removals and flags, as they were seen while it ran."""
    job = pipeline.Job(
        "orders", auto_fix=False, detect=False, lookups=[pipeline.LookupStep("customer", "o_custkey", "c_custkey", ["c_name"], {"order_by": ["c_custkey"]})],
        formulas=[Formula("", "filter_rows", conditions=[Condition("o_totalprice", "gte", 50000)])], rules=[rules.Rule("closed", "o_orderstatus", "equals", "F", reason="closed")],
    )
    done = pipeline.run(job, {"orders": orders, "customer": customer.where("c_custkey % 3 > 0")})
    return done.measured(lambda df: df.write.format("noop").mode("overwrite").save()).drop("seconds")


@query("lineitem", sql="SELECT 1 AS k, string_agg(flag, '; ' ORDER BY place) AS modes FROM (SELECT l_returnflag AS flag, min(l_orderkey * 100 + l_linenumber) AS place FROM lineitem GROUP BY 1)")
def lookup_list_hot_key(lineitem):
    """All rows of the right side share one key: the list holds each value once, in the order of its first row."""
    left = lineitem.sparkSession.range(1).select(F.lit(1).alias("k"))
    right = lineitem.select(F.lit(1).alias("k"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("modes"))
    return lookup.lookup(left, right, "k", "k", ["modes"], policy="list", order_by=["l_orderkey", "l_linenumber"])


@query("orders", "lineitem", sql="SELECT 1 AS place, 'l_orderkey' AS field UNION ALL SELECT 2, 'l_linenumber' FROM (SELECT count(*) FROM orders) WHERE (SELECT count(*) FROM lineitem) >= 0")
def unionable_groups(orders, lineitem):
    """Tables with the same names are found from their schemas; the rows listed are the columns of the group, in order."""
    parts = {"a": lineitem.select("l_orderkey", "l_linenumber"), "b": lineitem.select("l_linenumber", "l_orderkey"), "c": orders}
    group = reshape.unionable(parts)[0]
    united = reshape.union_with_origin({n: parts[n] for n in group})
    names = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(c).alias("field")) for i, c in enumerate(united.columns[:-1])])
    return united.limit(1).select(F.inline(names))


@query("orders", sql="""
SELECT c AS "column", dtype, samples, repeated_rows FROM (
 SELECT 'o_orderstatus' AS c, 'string' AS dtype, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders ORDER BY 1 LIMIT 3)) AS samples, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus) WHERE n > 1)::BIGINT AS repeated_rows
 UNION ALL SELECT 'o_orderpriority', 'string', (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY 1 LIMIT 3)), (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) WHERE n > 1)::BIGINT
 UNION ALL SELECT 'o_clerk', 'string', (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderkey % 4 || '' AS v FROM orders ORDER BY 1 LIMIT 3)), (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey % 4) WHERE n > 1)::BIGINT)""")
def profile_samples(orders):
    t = orders.select("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 4).cast("string").alias("o_clerk"))
    return profile.profile(t, "orders").select("column", "dtype", F.array_join("samples", ",").alias("samples"), "repeated_rows")


@query("orders", sql="SELECT 'o_orderkey' AS field, round(0.55 * count(DISTINCT o_orderkey) / count(*) + 0.25 + 0.2, 4) AS score FROM orders UNION ALL SELECT 'o_custkey', round(0.55 * count(DISTINCT o_custkey) / count(*) + 0.25 + 0.2, 4) FROM orders")
def key_scores(orders):
    return profile.key_candidates(profile.profile(orders.select("o_orderkey", "o_custkey"), "orders")).select(F.col("column").alias("field"), "score")


@query("orders", "customer", "nation", sql="SELECT CASE WHEN (SELECT count(*) FROM orders) >= (SELECT count(*) FROM customer) THEN 'orders' ELSE 'customer' END AS base")
def base_table(orders, customer, nation):
    sizes = {n: d.count() for n, d in (("orders", orders), ("customer", customer), ("nation", nation))}
    return nation.limit(1).select(F.lit(profile.base_table(sizes)).alias("base"))


@query("orders", "customer", sql="SELECT 'orders' AS left_table, 'custkey' AS left_field, 'customer' AS right_table, 'recommended' AS decision, 'used' AS reason FROM (SELECT count(*) AS n FROM orders) WHERE n > 0")
def diagnostics_of_lookups(orders, customer):
    named_ = {"orders": orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey"), "customer": customer.select(F.col("c_custkey").alias("custkey"), "c_name")}
    found = [r.asDict() for r in profile.relationships(named_).collect()]
    chosen = profile.recommend_lookups(named_, "orders", found)
    return profile.matching_diagnostics(orders, [r for r in found if r["left_table"] == "orders"], chosen)


@query("orders", sql="""
SELECT 'o_custkey blank' AS rule, 'error' AS severity FROM (SELECT count(*) AS n FROM orders) WHERE n > 0 UNION ALL SELECT 'order_date blank', 'error' UNION ALL SELECT 'amount blank', 'error' UNION ALL SELECT 'status blank', 'error' UNION ALL SELECT 'o_orderkey blank', 'error' UNION ALL SELECT 'customer not found', 'error' UNION ALL SELECT 'o_orderkey repeated', 'warn'""")
def recommend_rules(orders):
    profiles = [r.asDict() for r in profile.profile(bad_orders(orders), "orders", repeats=[]).collect()]
    made = profile.recommend_rules(profiles, [{"table": "customer"}], ["o_orderkey"])
    return orders.sparkSession.createDataFrame([(r.name, r.severity) for r in made], "rule string, severity string")


@query("orders", sql="""
SELECT 'o_custkey' AS field, CASE WHEN count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END) > 0 THEN 'missing' ELSE '' END AS issues, 'customer required' AS rules FROM orders
UNION ALL SELECT 'status', CASE WHEN count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END) > 0 THEN 'empty text' ELSE '' END, 'status allowed' FROM orders UNION ALL SELECT 'amount', '', 'amount positive' UNION ALL SELECT 'order_date', '', 'date valid' UNION ALL SELECT 'o_orderkey', '', ''""")
def cleaning_plan(orders):
    profiles = [r.asDict() for r in profile.profile(bad_orders(orders), "orders", repeats=[]).collect()]
    plan = profile.cleaning_plan(orders.sparkSession, profiles, RULES, [])
    return plan.select("field", F.array_join("issues", ",").alias("issues"), F.array_join("rules", ",").alias("rules"))


@query("orders", sql=f"SELECT * FROM (SELECT 'customer_blank' AS reason, min(CASE WHEN {_C} THEN CAST(o_orderkey AS VARCHAR) END) AS sample_key FROM orders UNION ALL SELECT 'amount_negative', min(CASE WHEN {_A} THEN CAST(o_orderkey AS VARCHAR) END) FROM orders UNION ALL SELECT 'status_not_allowed', min(CASE WHEN {_S} THEN CAST(o_orderkey AS VARCHAR) END) FROM orders UNION ALL SELECT 'date_bad', min(CASE WHEN {_D} THEN CAST(o_orderkey AS VARCHAR) END) FROM orders)")
def rule_samples(orders):
    return profile.rule_impact(bad_orders(orders), RULES, ["o_orderkey"]).select("reason", "sample_key")


@query("orders", sql=f"SELECT reason, count(*) AS rows FROM (SELECT unnest(['status_blank', 'status_not_allowed']) AS reason, o_orderkey FROM orders) WHERE (reason = 'status_blank' AND o_orderkey % 13 = 0) OR (reason = 'status_not_allowed' AND {_S}) GROUP BY 1")
def schema_rules(orders):
    """Rules compiled from a schema document, with one that repeats merged."""
    made = rules.rules_from_json_schema({"properties": {"status": {"enum": ["F", "O", "P"]}}, "required": ["status"]})
    made = rules.merge_rules([*made, Rule("again", "status", "is_blank", reason="status_blank", severity="warn")])
    return audit.label_summary(rules.apply_rules(bad_orders(orders), made), ["o_orderkey"]).select("reason", "rows")


@query("orders", sql="SELECT reason, min(o_orderkey) AS least FROM (SELECT 'customer_blank' AS reason, o_orderkey FROM orders WHERE " + _C + " UNION ALL SELECT 'date_bad', o_orderkey FROM orders WHERE " + _D + ") GROUP BY 1")
def label_samples(orders):
    t = ruled(orders).withColumn("key", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    found = audit.label_summary(t, ["key"], 1).where("reason in ('customer_blank', 'date_bad')")
    return found.select("reason", F.col("samples").cast("long").alias("least"))


@query("orders", sql=f"SELECT o_orderkey, 'amount' AS field, 'correct before use' AS action FROM orders WHERE {_A}")
def review_catalogue(orders):
    return audit.review_catalogue(ruled(orders), ["o_orderkey"]).where("field = 'amount'").select("o_orderkey", "field", "action")


@query("orders", sql=f"SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 30 = 0 THEN false WHEN o_orderkey % 6 = 0 THEN true ELSE NOT ({_C} OR {_A}) END")
def contrary_decisions(orders):
    """Every sixth record is accepted and noted as pending, and every fifth of those excluded too: exclusion wins."""
    k = F.col("o_orderkey")
    lists = orders.where(k % 6 == 0).select(k, F.explode(F.when(k % 30 == 0, F.array(F.lit("accept"), F.lit("exclude"), F.lit("pending"))).otherwise(F.array(F.lit("pending"), F.lit("accept")))).alias("decision"))
    return audit.apply_decisions(ruled(orders), lists, ["o_orderkey"])[0].select("o_orderkey")


@query("orders", sql="SELECT o_orderkey, o_custkey FROM orders")
def contract_kept(orders):
    t = orders.select("o_orderkey", "o_custkey")
    return audit.assert_contract(t, audit.Contract(("o_orderkey", "o_custkey"), "exact", unique=("o_orderkey",)))


@query("orders", sql=f"SELECT o_orderkey, {_C} AS missing, {_D} AS dates FROM orders")
def findings_as_reasons(orders):
    found = detect.detect(bad_orders(orders).select("o_orderkey", "o_custkey", "order_date"), row_issues=False, keys=[])
    kinds = F.transform(detect.as_issues(), lambda x: x["reason"])
    return found.select("o_orderkey", F.array_contains(kinds, "dirty:o_custkey:null_value").alias("missing"), F.array_contains(kinds, "dirty:order_date:date_parse_failed").alias("dates"))


@query("customer", sql="SELECT c_custkey, c_custkey % 7 = 0 AS hidden, c_custkey % 5 < 2 AS mixed, c_custkey % 11 = 0 AS negative FROM customer")
def detect_text_and_counts(customer):
    k = F.col("c_custkey")
    spelled = F.when(k % 5 == 0, "GOLD").when(k % 5 == 1, "Gold").otherwise(F.concat(F.lit("plan "), (k % 5).cast("string")))
    t = customer.select("c_custkey", spelled.alias("plan"), F.when(k % 7 == 0, F.concat(F.lit("a"), F.lit("​"), F.lit("b"))).otherwise("ab").alias("mark"), F.when(k % 11 == 0, -1).otherwise(5).alias("stock"))
    found = detect.detect(t, row_issues=False, keys=[])
    return found.select("c_custkey", detect.any_finding("invisible_characters").alias("hidden"), detect.any_finding("mixed_case_duplicates").alias("mixed"), detect.any_finding("negative_numeric_value").alias("negative"))


@query("region", sql="SELECT '' AS field, 'empty_table' AS issue, 0::BIGINT AS affected_rows UNION ALL SELECT 'r_name', 'duplicate_columns', 2 FROM region GROUP BY 1, 2 UNION ALL SELECT 'Unnamed: 3', 'unnamed_column', 1")
def detect_structure(region):
    t = region.where("r_regionkey < 0").select("r_regionkey", "r_name", F.col("r_name").alias("again")).toDF("r_regionkey", "r_name", "r_name")
    return detect.issue_summary(detect.detect(t, keys=[]), columns=[*t.columns, "Unnamed: 3"]).select("field", "issue", "affected_rows")


@query("nation", sql="SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE n_regionkey WHEN 0 THEN 'line' || chr(10) || 'break, \"quoted\"' ELSE n_name END AS n_name FROM nation")
def csv_files(nation):
    """Written as CSV files and read back through discovery: cells with line breaks, quotes and separators."""
    folder = f"{scratch_dir(nation.sparkSession)}/loamwork/csv-{abs(hash(nation.semanticHash())) % 10**9}"
    t = nation.select("n_nationkey", F.when(F.col("n_regionkey") == 0, 'line\nbreak, "quoted"').otherwise(F.col("n_name")).alias("n_name"))
    path = tables.write_tables({"nations": t}, folder, "csv")[0]
    encoding, line_breaks = tables.csv_traits(nation.sparkSession, [path])
    return nation.sparkSession.read.option("header", True).option("encoding", encoding).option("multiLine", line_breaks).option("escape", '"').csv(path)


@query("orders", sql="SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'import_template_field' AS requirement FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def template_fields(orders):
    """Fields that an import template asks for; the template is made of the first order's key."""
    first = str(orders.agg(F.min("o_orderkey")).first()[0])
    found = rules.template_requirements({"import_orders": [first], "orders": orders.columns}, [{"table": "import_orders", "file": "/in/a", "file_name": "a"}, {"table": "orders", "file": "/in/b", "file_name": "b"}])
    return orders.sparkSession.createDataFrame([(r["field"], r["requirement"]) for r in found], "o_orderkey string, requirement string")

