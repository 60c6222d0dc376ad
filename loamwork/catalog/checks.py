"""Queries over profiles, detectors, rules, audits, reviews and analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import Condition, condition, with_repeats
from ..operators import analysis, audit, detect, profile, rules
from ..operators.rules import Rule
from .base import registry

REGISTERED, query = registry()

#: Orders with defects on every few keys.
_BAD = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
 CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN ' ' || o_orderstatus || ' ' WHEN 2 THEN 'ＯＰ' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 17 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount,
 CASE o_orderkey % 19 WHEN 0 THEN 'not a date' WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date FROM orders"""


def bad_orders(orders):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        "o_orderkey", F.when(k % 11 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 13 == 0, "").when(k % 13 == 1, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).when(k % 13 == 2, "ＯＰ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 17 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(k % 19 == 0, "not a date").when(k % 19 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(day).alias("order_date"),
    )


@query("orders", sql="""
SELECT 'orders' AS "table", c AS "column", count(*) AS rows, count(*) - count(v) AS nulls, round((count(*) - count(v)) / count(*), 6) AS null_rate, count(CASE WHEN trim(v) = '' THEN 1 END) AS empty_strings, count(DISTINCT v) AS distinct_values
FROM (SELECT 'o_custkey' AS c, CAST(o_custkey AS VARCHAR) AS v FROM (""" + _BAD + """) UNION ALL SELECT 'status', status FROM (""" + _BAD + """) UNION ALL SELECT 'order_date', order_date FROM (""" + _BAD + """)) GROUP BY 2""")
def profile_columns(orders):
    return profile.profile(bad_orders(orders).select("o_custkey", "status", "order_date"), "orders", repeats=[]).select("table", "column", "rows", "nulls", "null_rate", "empty_strings", "distinct_values")


@query("orders", sql="""
SELECT 'orders' AS "table", c AS "column", round(count(DISTINCT v) / count(v), 4) AS uniqueness, round(count(v) / count(*), 4) AS completeness, CASE WHEN count(DISTINCT v) = count(*) THEN 'primary' ELSE CASE WHEN round(0.55 * count(DISTINCT v) / count(v) + 0.25 * count(v) / count(*) + 0.2, 4) >= 0.6 THEN 'lookup' ELSE 'low' END END AS level
FROM (SELECT 'o_orderkey' AS c, o_orderkey AS v FROM orders UNION ALL SELECT 'o_custkey', CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END FROM orders) GROUP BY 2""")
def key_candidates(orders):
    return profile.key_candidates(profile.profile(bad_orders(orders), "orders", repeats=[])).select("table", "column", "uniqueness", "completeness", "level")


@query("orders", "customer", sql="SELECT 'orders' AS \"table\", count(*) AS rows, 6 AS columns, 0::BIGINT AS duplicate_rows FROM orders UNION ALL SELECT 'customer', 2 * count(*), 5, count(*) FROM customer")
def overview(orders, customer):
    return profile.overview({"orders": orders, "customer": customer.union(customer)})


_FOUND = """SELECT 'status' AS field, 'empty_string' AS issue, count(*) AS affected_rows FROM orders WHERE o_orderkey % 13 = 0 HAVING count(*) > 0
UNION ALL SELECT 'status', 'outer_spaces', count(*) FROM orders WHERE o_orderkey % 13 = 1 UNION ALL SELECT 'status', 'full_width_characters', count(*) FROM orders WHERE o_orderkey % 13 = 2
UNION ALL SELECT 'o_custkey', 'null_value', count(*) FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'amount', 'negative_amount', count(*) FROM orders WHERE o_orderkey % 17 = 0 AND o_totalprice > 0
UNION ALL SELECT 'order_date', 'date_parse_failed', count(*) FROM orders WHERE o_orderkey % 19 = 0 UNION ALL SELECT 'order_date', 'mixed_date_formats', count(*) FROM orders"""


@query("orders", sql=_FOUND)
def detect_cells(orders):
    found = detect.detect(bad_orders(orders), row_issues=False, keys=[])
    return detect.issue_summary(found).where("issue <> 'outlier'").select("field", "issue", "affected_rows")


_ROWS = """SELECT o_orderkey AS id, CASE o_orderkey % 23 WHEN 0 THEN NULL WHEN 1 THEN 'Status' WHEN 2 THEN 'total' WHEN 3 THEN 'note: see below' ELSE o_orderstatus END AS status,
 CASE o_orderkey % 23 WHEN 0 THEN NULL WHEN 1 THEN 'amount' WHEN 2 THEN '12' WHEN 3 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS amount FROM orders"""


@query("orders", sql="SELECT CASE o_orderkey % 23 WHEN 0 THEN 'all_empty_row' WHEN 1 THEN 'repeated_header_row' WHEN 2 THEN 'summary_row' WHEN 3 THEN 'comment_row' END AS issue, count(*) AS affected_rows FROM orders WHERE o_orderkey % 23 < 4 GROUP BY 1 UNION ALL SELECT 'duplicate_row', count(*) FROM orders WHERE o_orderkey % 23 < 4")
def detect_rows(orders):
    k = F.col("o_orderkey") % 23
    t = orders.select(F.when(k == 0, F.lit(None)).when(k == 1, "Status").when(k == 2, "total").when(k == 3, "note: see below").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k == 1, "amount").when(k == 2, "12").when(k > 3, F.col("o_orderkey").cast("string")).alias("amount"))
    found = detect.detect(t, keys=[])
    return detect.issue_summary(found).where("field = ''").select("issue", "affected_rows")


@query("customer", sql="SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND (SELECT max(c_acctbal) FROM customer) > 0")
def detect_negative(customer):
    found = detect.detect(customer.select("c_custkey", F.col("c_acctbal").alias("balance")), row_issues=False, keys=[])
    return found.where(detect.any_finding("negative_amount")).select("c_custkey")


@query("lineitem", sql="""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS price FROM lineitem), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM v)
SELECT l_orderkey, l_linenumber, l_partkey FROM v, q WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)""")
def detect_outlier_iqr(lineitem):
    t = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_orderkey") % 97 == 0, F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice")).alias("price"))
    found = detect.detect(t, row_issues=False, keys=[])
    return found.where(F.exists("findings", lambda x: (x["field"] == "price") & (x["issue"] == "outlier"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("orders", sql="SELECT o_orderkey, o_orderkey % 19 = 0 AS failed FROM orders")
def detect_dates(orders):
    found = detect.detect(bad_orders(orders).select("o_orderkey", "order_date"), row_issues=False, keys=[])
    return found.select("o_orderkey", detect.any_finding("date_parse_failed").alias("failed"))


@query("orders", sql="SELECT o_orderkey, o_orderkey % 10 > 0 AS as_text FROM orders")
def detect_numeric_text(orders):
    t = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).when(F.col("o_orderkey") % 10 == 1, "?").otherwise(F.col("o_totalprice").cast("string")).alias("v"))
    return detect.detect(t, row_issues=False, keys=[]).select("o_orderkey", detect.any_finding("number_as_text").alias("as_text"))


@query("events", sql="SELECT event_id, count(*) OVER (PARTITION BY user_id) > 1 AS repeated FROM events")
def detect_dup_key(events):
    return detect.detect(events.select("event_id", "user_id"), row_issues=False, keys=["user_id"]).select("event_id", detect.any_finding("duplicate_key").alias("repeated"))


@query("lineitem", sql="""
SELECT field, issue, count(*) AS affected_rows FROM (
    SELECT 'l_orderkey' AS field, 'duplicate_key' AS issue, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
    UNION ALL SELECT 'l_partkey', 'duplicate_key', count(*) OVER (PARTITION BY l_partkey) FROM lineitem
    UNION ALL SELECT 'l_suppkey', 'duplicate_key', count(*) OVER (PARTITION BY l_suppkey) FROM lineitem) WHERE n > 1 GROUP BY 1, 2""")
def detect_default_keys(lineitem):
    """All key-like columns, found by their names, and whole rows, in one narrow shuffle."""
    return detect.issue_summary(detect.detect(lineitem, issues=("duplicate_key", "duplicate_row"))).where("issue in ('duplicate_key', 'duplicate_row')").select("field", "issue", "affected_rows")


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1 THEN 'pair' END, CASE WHEN count(*) OVER (PARTITION BY l_shipdate) > 1 THEN 'day' END,
 CASE WHEN count(*) OVER (PARTITION BY l_extendedprice) = 1 THEN 'price' END) AS problem FROM lineitem""")
def rules_duplicated_keys(lineitem):
    """Three ``duplicated`` rules over different columns, one of them negated and one over a derived pair."""
    df = lineitem.withColumn("pair", F.concat_ws("-", "l_partkey", "l_suppkey"))
    marked, tests = with_repeats(df, [Condition("pair", "duplicated"), Condition("l_shipdate", "duplicated"), Condition("l_extendedprice", "duplicated", negate=True)])
    said = [F.when(condition(t, marked.columns), n) for t, n in zip(tests, ("pair", "day", "price"))]
    return marked.select("l_orderkey", "l_linenumber", F.concat_ws(";", *said).alias("problem"))


@query("orders", sql="SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 2 THEN 'OP' ELSE o_orderstatus END AS status FROM orders")
def auto_fix(orders):
    return detect.auto_fix(bad_orders(orders)).select("o_orderkey", "status")


@query("orders", sql="SELECT o_orderkey, 'status' AS field, CASE o_orderkey % 13 WHEN 1 THEN ' ' || o_orderstatus || ' ' ELSE 'ＯＰ' END AS before, CASE o_orderkey % 13 WHEN 1 THEN o_orderstatus ELSE 'OP' END AS after FROM orders WHERE o_orderkey % 13 IN (1, 2)")
def fix_audit(orders):
    return detect.fix_audit(bad_orders(orders), ["o_orderkey"])


RULES = [
    Rule("customer required", "o_custkey", "is_blank", reason="customer_blank", severity="error"),
    Rule("amount positive", "amount", "lt", 0, reason="amount_negative", severity="error"),
    Rule("status allowed", "status", "not_in", values=("F", "O", "P"), reason="status_not_allowed", severity="warn"),
    Rule("date valid", "order_date", "date_invalid", reason="date_bad", severity="warn"),
]
_C, _A = "o_orderkey % 11 = 0", "(o_orderkey % 17 = 0 AND o_totalprice > 0)"
_S, _D = "o_orderkey % 13 IN (0, 2)", "o_orderkey % 19 = 0"
_REASONS = f"concat_ws(';', CASE WHEN {_C} THEN 'customer_blank' END, CASE WHEN {_A} THEN 'amount_negative' END, CASE WHEN {_S} THEN 'status_not_allowed' END, CASE WHEN {_D} THEN 'date_bad' END)"


def ruled(orders):
    return rules.apply_rules(bad_orders(orders), RULES)


@query("orders", sql=f"SELECT o_orderkey, {_REASONS} AS problem FROM orders")
def rules_apply(orders):
    return ruled(orders).select("o_orderkey", rules.issue_text().alias("problem"))


@query("orders", sql=f"SELECT o_orderkey, CASE WHEN {_C} OR {_A} THEN 'review' ELSE 'usable' END AS part FROM orders")
def split_usable_review(orders):
    return rules.mark_usable(ruled(orders)).select("o_orderkey", "part")


@query("orders", sql=f"SELECT count(*) AS total, count(*) AS output, 0::BIGINT AS filtered_out, count(CASE WHEN NOT ({_C} OR {_A}) THEN 1 END) AS valid, count(CASE WHEN {_C} OR {_A} THEN 1 END) AS abnormal FROM orders")
def run_counts(orders):
    return rules.run_counts(ruled(orders))


@query("orders", sql=f"""
SELECT 'customer required' AS rule, 'customer_blank' AS reason, 'error' AS severity, count(CASE WHEN {_C} THEN 1 END) AS hits, round(count(CASE WHEN {_C} THEN 1 END) / count(*), 6) AS rate FROM orders
UNION ALL SELECT 'amount positive', 'amount_negative', 'error', count(CASE WHEN {_A} THEN 1 END), round(count(CASE WHEN {_A} THEN 1 END) / count(*), 6) FROM orders
UNION ALL SELECT 'status allowed', 'status_not_allowed', 'warn', count(CASE WHEN {_S} THEN 1 END), round(count(CASE WHEN {_S} THEN 1 END) / count(*), 6) FROM orders
UNION ALL SELECT 'date valid', 'date_bad', 'warn', count(CASE WHEN {_D} THEN 1 END), round(count(CASE WHEN {_D} THEN 1 END) / count(*), 6) FROM orders""")
def rule_impact(orders):
    return profile.rule_impact(bad_orders(orders), RULES)


@query("orders", sql=f"""
SELECT o_orderkey, 'customer_blank' AS reason, 'o_custkey' AS field, 'error' AS severity, NULL AS value FROM orders WHERE {_C}
UNION ALL SELECT o_orderkey, 'status_not_allowed', 'status', 'warn', CASE o_orderkey % 13 WHEN 0 THEN '' ELSE 'ＯＰ' END FROM orders WHERE {_S}
UNION ALL SELECT o_orderkey, 'date_bad', 'order_date', 'warn', 'not a date' FROM orders WHERE {_D}""")
def record_audit(orders):
    return audit.record_audit(ruled(orders), ["o_orderkey"]).where("field <> 'amount'").select("o_orderkey", "reason", "field", "severity", "value")


@query("orders", sql=f"SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split({_REASONS}, ';')) AS reason FROM orders) WHERE reason <> '' GROUP BY 1")
def label_summary(orders):
    return audit.label_summary(ruled(orders), ["o_orderkey"]).select("reason", "rows")


@query("orders", sql="SELECT o_orderkey, 'status' AS field, CASE o_orderkey % 13 WHEN 1 THEN ' ' || o_orderstatus || ' ' ELSE 'ＯＰ' END AS before, CASE o_orderkey % 13 WHEN 1 THEN o_orderstatus ELSE 'OP' END AS after, 'changed' AS change FROM orders WHERE o_orderkey % 13 IN (1, 2)")
def field_changes(orders):
    before = bad_orders(orders)
    return audit.field_changes(before, detect.auto_fix(before), ["o_orderkey"], producer="auto_fix").drop("producer")


@query("orders", sql="SELECT 'status' AS field, 'changed' AS change, count(*) AS changes, arg_min(CASE o_orderkey % 13 WHEN 1 THEN ' ' || o_orderstatus || ' ' ELSE 'ＯＰ' END, o_orderkey) AS example_before, arg_min(CASE o_orderkey % 13 WHEN 1 THEN o_orderstatus ELSE 'OP' END, o_orderkey) AS example_after FROM orders WHERE o_orderkey % 13 IN (1, 2)")
def change_manifest(orders):
    before = bad_orders(orders)
    return audit.change_manifest(audit.field_changes(before, detect.auto_fix(before), ["o_orderkey"]), ["o_orderkey"])


@query("orders", sql=f"SELECT o_orderkey, 'removed' AS action, 'amount below zero' AS rule FROM orders WHERE {_A}")
def row_actions(orders):
    before = bad_orders(orders)
    return audit.row_actions(before, before.where("amount >= 0"), ["o_orderkey"], "amount below zero")


@query("orders", sql=f"SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 29 = 0 THEN true WHEN o_orderkey % 31 = 0 THEN false ELSE NOT ({_C} OR {_A}) END")
def review_apply(orders):
    decided = orders.where("o_orderkey % 29 = 0 OR o_orderkey % 31 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 29 == 0, "accept").otherwise("exclude").alias("decision"))
    return audit.apply_decisions(ruled(orders), decided, ["o_orderkey"])[0].select("o_orderkey")


@query("orders", sql=f"SELECT o_orderkey, CASE WHEN {_C} OR {_A} THEN '需处理' ELSE '通过' END AS status, {_REASONS} AS problem, {_REASONS} <> '' AS reported FROM orders")
def business_result(orders):
    return audit.business_result(ruled(orders)).select("o_orderkey", "status", "problem", "reported")


@query("orders", sql=f"""
SELECT 'rule' AS source, reason, count(*) AS affected_rows, reason IN ('customer_blank', 'amount_negative') AS affects_final FROM (SELECT unnest(string_split({_REASONS}, ';')) AS reason FROM orders) WHERE reason <> '' GROUP BY 2
UNION ALL SELECT 'detector', field || ':' || issue, affected_rows, issue IN ('empty_string', 'null_value', 'negative_amount', 'date_parse_failed') FROM ({_FOUND})""")
def exception_impact(orders):
    found = detect.detect(bad_orders(orders), row_issues=False, keys=[])
    return detect.exception_impact(ruled(orders), found).where("reason not like '%:outlier'").select("source", "reason", "affected_rows", "affects_final")


@query("orders", sql=f"""
WITH c AS (SELECT count(*) AS n, count(CASE WHEN {_C} OR {_A} THEN 1 END) AS x FROM orders)
SELECT round_even(100 - least(25, round_even(greatest(0, x / n - 0.05) * 100, 2)) - 6 - least(12, round_even(x / n * 35, 2)), 2) AS score, n AS rows FROM c""")
def quality_score(orders):
    n = ruled(orders).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(rules.needs_review(), 1)).alias("x")).first()
    return detect.quality_score(orders.sparkSession, n["n"], n["x"], 2, n["x"], 0)[0]


@query("orders", sql="SELECT o_orderstatus AS status, count(*) AS rows, round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1")
def status_distribution(orders):
    return analysis.status_distribution(orders, "o_orderstatus")


@query("orders", sql="""
SELECT dimension, category, rows FROM (SELECT 'status' AS dimension, CASE WHEN o_orderkey % 13 = 0 THEN '未填写' WHEN o_orderkey % 13 = 2 THEN 'ＯＰ' ELSE o_orderstatus END AS category, count(*) AS rows FROM orders GROUP BY 2)
UNION ALL (SELECT 'priority', o_orderpriority, count(*) AS rows FROM orders GROUP BY 2 ORDER BY rows DESC, 2 LIMIT 5)""")
def group_distribution(orders):
    t = bad_orders(orders).select("o_orderkey", "status").join(orders.select("o_orderkey", F.col("o_orderpriority").alias("priority")), "o_orderkey")
    return analysis.group_distribution(t, ["status", "priority"])


@query("lineitem", sql="""
SELECT 'l_quantity' AS field, count(l_quantity) AS n, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(quantile_cont(l_quantity, 0.9), 4) AS p90 FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), round(sum(l_tax), 4), round(avg(l_tax), 4), min(l_tax), max(l_tax), round(quantile_cont(l_tax, 0.9), 4) FROM lineitem""")
def numeric_summary(lineitem):
    return analysis.numeric_summary(lineitem, ["l_quantity", "l_tax"])


@query("orders", sql="SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows FROM orders WHERE o_orderkey % 19 > 0 GROUP BY 1")
def monthly_trend(orders):
    return analysis.monthly_trend(bad_orders(orders))


@query("orders", sql=f"SELECT dimension, reason, count(*) AS rows FROM (SELECT o_orderpriority AS dimension, unnest(string_split({_REASONS}, ';')) AS reason FROM orders) WHERE reason <> '' GROUP BY 1, 2 ORDER BY rows DESC, 1, 2 LIMIT 20")
def cross_issues(orders):
    t = ruled(orders).join(orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return analysis.cross_issues(t, "o_orderpriority", 20)


@query("orders", sql="SELECT 'o_custkey' AS field, count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END) AS missing, round(count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END) / count(*), 4) AS rate FROM orders UNION ALL SELECT 'status', count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END), round(count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END) / count(*), 4) FROM orders")
def missing_rates(orders):
    return analysis.missing_rates(bad_orders(orders), ["o_custkey", "status"])


@query("orders", sql=f"SELECT reason, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM (SELECT unnest(string_split({_REASONS}, ';')) AS reason FROM orders) WHERE reason <> '' GROUP BY 1")
def exception_distribution(orders):
    return analysis.exception_distribution(ruled(orders))


@query("orders", sql=f"SELECT count(*) AS rows, count(CASE WHEN {_A} THEN 1 END) AS removed FROM orders")
def removal_guard(orders):
    before = bad_orders(orders)
    n, gone = profile.guard_removal(before, before.where("amount >= 0"))
    return orders.limit(1).select(F.lit(n).cast("long").alias("rows"), F.lit(gone).cast("long").alias("removed"))


@query("orders", "customer", sql="SELECT 'customer' AS lookup, 'c_mktsegment' AS field, 'first' AS policy FROM orders LIMIT 1")
def recommend_lookups(orders, customer):
    tables = {"orders": orders.withColumnRenamed("o_custkey", "custkey"), "customer": customer.select(F.col("c_custkey").alias("custkey"), "c_mktsegment")}
    found = profile.recommend_lookups(tables, "orders", [r.asDict() for r in profile.relationships(tables).collect()])
    rows = [(x["table"], f, x["policy"]) for x in found for f in x["fields"]]
    return orders.sparkSession.createDataFrame(rows, "lookup string, field string, policy string")


@query("documents", sql=r"SELECT source AS field, 'required' AS kind, '' AS value FROM documents GROUP BY 1 UNION ALL SELECT source, 'min', CAST(count(*) AS VARCHAR) FROM documents GROUP BY 1 UNION ALL SELECT source, 'allowed', 'de,en' FROM documents GROUP BY 1")
def extract_rules(documents):
    """Rule sentences about each source, written from the table's own counts."""
    counts = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws("\n", F.concat(F.col("source"), F.lit(". is required")), F.concat(F.col("source"), F.lit(". >= "), F.col("n").cast("string")), F.concat(F.col("source"), F.lit(". allowed values: de, en")))
    names = [r[0] for r in counts.select("source").distinct().collect()]
    sentences = counts.select(text.alias("text"))
    found = rules.extract_rules(sentences, [f"{n}." for n in names])
    return found.withColumn("field", F.expr("substring(field, 1, length(field) - 1)"))


@query("orders", sql=f"""
SELECT o_orderkey, 'ANN-' || substring(sha256(o_orderkey || chr(31) || 'status' || chr(31) || 'status_not_allowed'), 1, 12) AS task_id, 'value' AS category, 'confirm' AS action, 'pending' AS status FROM orders WHERE {_S}""")
def review_tasks(orders):
    return audit.review_tasks(ruled(orders), ["o_orderkey"]).where("field = 'status'").select("o_orderkey", "task_id", "category", "action", "status")


@query("orders", sql=f"""
SELECT 'missing' AS category, 'error' AS severity, 'pending' AS status, count(*) AS tasks FROM orders WHERE {_C} UNION ALL SELECT 'value', 'error', 'pending', count(*) FROM orders WHERE {_A}
UNION ALL SELECT 'value', 'warn', 'pending', count(*) FROM orders WHERE {_S} UNION ALL SELECT 'date', 'warn', 'pending', count(*) FROM orders WHERE {_D}""")
def task_summary(orders):
    return audit.task_summary(audit.review_tasks(ruled(orders), ["o_orderkey"]))


@query("orders", sql=f"""
SELECT 'all rows' AS item, count(*) AS rows FROM orders UNION ALL SELECT 'usable', count(*) FROM orders WHERE NOT ({_C} OR {_A}) UNION ALL SELECT 'to review', count(*) FROM orders WHERE {_C} OR {_A}
UNION ALL SELECT reason, count(*) FROM (SELECT unnest(string_split({_REASONS}, ';')) AS reason FROM orders) WHERE reason <> '' GROUP BY 1""")
def business_summary(orders):
    return audit.business_summary(ruled(orders))


@query("orders", sql=f"SELECT 'delivered' AS part, count(*) AS rows FROM orders WHERE NOT ({_C} OR {_A}) UNION ALL SELECT 'withheld', count(*) FROM orders WHERE {_C} OR {_A} UNION ALL SELECT 'problems', count(*) FROM orders WHERE {_C} OR {_A} OR {_S} OR {_D}")
def delivery_views(orders):
    parts = audit.delivery(ruled(orders))
    each = [df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows")) for n, df in parts.items()]
    return each[0].union(each[1]).union(each[2])


@query("orders", sql=f"SELECT o_orderkey, {_D} AS found FROM orders WHERE {_D}")
def flagged_in_scope(orders):
    return rules.flagged(ruled(orders), ["date"]).select("o_orderkey", F.lit(True).alias("found"))


@query("lineitem", sql="SELECT l_quantity, l_extendedprice FROM (SELECT * FROM lineitem WHERE l_linenumber % 3 > 0 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200)")
def scatter_points(lineitem):
    q = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("l_quantity")
    return analysis.scatter_points(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q, "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("orders", sql=f"""
SELECT 'missing' AS topic, 'o_custkey is missing in ' || count(*) || ' rows' AS finding FROM orders WHERE {_C} UNION ALL SELECT 'status', o_orderstatus || ': ' || count(*) || ' rows' FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'exceptions', reason || ': ' || count(*) || ' rows' FROM (SELECT unnest(string_split({_REASONS}, ';')) AS reason FROM orders) WHERE reason <> '' GROUP BY reason""")
def finding_sentences(orders):
    out = analysis.findings(analysis.status_distribution(orders, "o_orderstatus"), analysis.missing_rates(bad_orders(orders), ["o_custkey"]), analysis.exception_distribution(ruled(orders)))
    return out.withColumn("finding", F.regexp_replace("finding", r" \([0-9.]+ %\)$", ""))


@query("orders", "customer", sql="SELECT 'o.custkey -> c.custkey' AS relationship, count(DISTINCT o_custkey) AS left_keys, count(DISTINCT o_custkey) AS matched_keys, 1.0::DOUBLE AS match_rate FROM orders UNION ALL SELECT 'c.custkey -> o.custkey', count(*), count(n), round(count(n) / count(*), 4) FROM (SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)")
def match_rates(orders, customer):
    return analysis.match_rates(profile.relationships({"o": orders.select(F.col("o_custkey").alias("custkey")), "c": customer.select(F.col("c_custkey").alias("custkey"))}))


@query("orders", sql="SELECT o_orderkey FROM orders WHERE o_orderkey % 23 > 2")
def non_record_rows(orders):
    from ..functions.predicates import non_record_row

    k = F.col("o_orderkey") % 23
    t = orders.select("o_orderkey", F.when(k == 0, F.lit(None)).when(k == 1, "Status").when(k == 2, "合计").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k == 1, "amount").when(k == 2, "12").when(k > 3, "5").alias("amount"))
    return t.where(~non_record_row(["status", "amount"])).select("o_orderkey")


@query("orders", sql="SELECT count(DISTINCT o_custkey) AS records FROM orders")
def record_count(orders):
    from ..operators.summarize import record_count as count

    return count(orders.select(F.col("o_custkey").alias("_row_id")))


@query("orders", sql="SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def removed_rows(orders):
    from ..operators.reshape import removed_rows as removed

    return removed(orders, orders.where("o_totalprice <= 300000"), ["o_orderkey"]).select("o_orderkey")
