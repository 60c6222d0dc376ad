"""Queries over files and templates, keys in compatible forms, relationships of many tables, profile states and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, audit, detect, impact, lookup, profile, reshape, rules, states, summarize
from ..operators.rules import Rule
from ..sources import rule_files, tables
from ..sources.scratch import scratch_dir
from .base import registry
from .checks import _A, _BAD, _C, _D, _S, RULES, bad_orders

REGISTERED, query = registry()


def _folder(df: DataFrame, name: str) -> str:
    return f"{scratch_dir(df.sparkSession)}/loamwork/{name}-{abs(df.semanticHash())}"


@query("supplier", sql="SELECT s_suppkey, s_suppkey AS found FROM supplier")
def lookup_compatible_characters(supplier):
    """Keys typed as ligatures, circled digits, half-width kana, composed or decomposed letters meet their plain forms."""
    k, n = F.col("s_suppkey") % 6, F.col("s_suppkey").cast("string")
    pick = lambda forms: reduce(lambda c, i: c.when(k == i, forms[i]), range(1, 6), F.when(k == 0, forms[0]))
    typed = supplier.select("s_suppkey", F.concat(F.lit("　"), pick(["①", "ﬁn", "ｶﾞ", "Å", "é", "㎏"]), F.lit("-"), n).alias("typed"))
    plain = supplier.select(F.col("s_suppkey").alias("found"), F.concat(pick(["1", "FIN", "ガ", "å", "É", "kg"]), F.lit("-"), n).alias("plain"))
    return lookup.lookup(typed, plain, "typed", "plain", ["found"], mode="normalized_exact", order_by=["found"]).select("s_suppkey", "found")


_SIDES = {"orders": "SELECT 'orders' AS t, CAST(o_custkey AS VARCHAR) AS k FROM orders", "customer": "SELECT 'customer', CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS VARCHAR) END FROM customer", "supplier": "SELECT 'supplier', CAST(s_nationkey AS VARCHAR) FROM supplier"}


@query("orders", "customer", "supplier", sql="""
WITH cells AS (""" + " UNION ALL ".join(_SIDES.values()) + """), c AS (SELECT t, k, count(*) AS n FROM cells GROUP BY 1, 2), p AS (SELECT a.t AS l, b.t AS r FROM (SELECT DISTINCT t FROM cells) a, (SELECT DISTINCT t FROM cells) b WHERE a.t <> b.t),
m AS (SELECT p.l, p.r, x.k, x.n AS nl, CASE WHEN x.k IS NOT NULL THEN coalesce(y.n, 0) ELSE 0 END AS nr FROM p JOIN c x ON x.t = p.l LEFT JOIN c y ON y.t = p.r AND y.k = x.k),
twice AS (SELECT t AS r, list(k ORDER BY k)[1:3] AS ks FROM c WHERE n > 1 AND k IS NOT NULL GROUP BY 1), gone AS (SELECT l, r, list(k ORDER BY k)[1:3] AS ks FROM m WHERE k IS NOT NULL AND nr = 0 GROUP BY 1, 2)
SELECT m.l AS left_table, m.r AS right_table, count(k) AS left_keys, count(CASE WHEN nr > 0 THEN 1 END) AS matched_keys, sum(CASE WHEN nr > 0 THEN nl ELSE 0 END)::BIGINT AS matched_rows,
 round(sum(CASE WHEN nr > 0 THEN nl ELSE 0 END) / sum(CASE WHEN k IS NOT NULL THEN nl END), 4) AS row_match_rate, sum(nl * greatest(nr, 1))::BIGINT AS output_rows,
 coalesce(array_to_string(any_value(gone.ks), ','), '') AS unmatched, coalesce(array_to_string(any_value(twice.ks), ','), '') AS repeated
FROM m LEFT JOIN gone ON gone.l = m.l AND gone.r = m.r LEFT JOIN twice ON twice.r = m.r GROUP BY 1, 2""")
def relationships_of_tables(orders, customer, supplier):
    """Three tables that share a key, in all six directions, from one index; samples of keys without a partner and of repeats."""
    named = {"orders": orders.select(F.col("o_custkey").alias("custkey")), "customer": customer.select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")).alias("cust_key")), "supplier": supplier.select(F.col("s_nationkey").alias("CustKey"))}
    found = profile.relationships(named, samples=3)
    return found.select("left_table", "right_table", "left_keys", "matched_keys", "matched_rows", "row_match_rate", "output_rows", F.array_join("unmatched_samples", ",").alias("unmatched"), F.array_join("repeated_samples", ",").alias("repeated"))


def _state_sql(column: str, value: str, number: str) -> str:
    first = "SELECT list(v ORDER BY part, place)[1:3] FROM (SELECT part, CAST(v AS VARCHAR) AS v, o_orderkey AS place FROM b WHERE v IS NOT NULL)"
    return f"""SELECT '{column}' AS "column", count(*) AS rows, count(*) - count(v) AS nulls, count(CASE WHEN trim(CAST(v AS VARCHAR)) = '' THEN 1 END) AS empty_strings, count(x) AS numbers, round(max(x), 2) AS most, array_to_string(({first}), ',') AS samples, true AS near
 FROM (WITH b AS (SELECT o_orderstatus AS part, o_orderkey, {value} AS v, {number} AS x FROM orders) SELECT * FROM b)""".replace("FROM b WHERE", f"FROM (SELECT o_orderstatus AS part, o_orderkey, {value} AS v FROM orders) WHERE")


@query("orders", sql=" UNION ALL ".join([
    _state_sql("o_orderkey", "o_orderkey", "o_orderkey"), _state_sql("o_custkey", "CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END", "CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END"),
    _state_sql("status", "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderstatus END", "NULL::DOUBLE")]))
def profile_states(orders):
    """Each order status is a part: its states are written, read back and united. Distinct counts and medians stand beside
    the exact ones, and ``near`` tells whether they are within four times their stated errors."""
    k = F.col("o_orderkey")
    t = orders.select("o_orderkey", F.when(k % 11 > 0, F.col("o_custkey")).alias("o_custkey"), F.when(k % 13 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderstatus").alias("part"))
    folder = _folder(t, "states")
    states.profile_states(t, "part", ["o_orderkey"]).where("column <> 'part'").write.mode("overwrite").parquet(folder)
    found = states.profile_of(states.unite(t.sparkSession.read.parquet(folder)), quantiles=[0.5])
    exact = profile.profile(t.drop("part"), repeats=[]).select("column", F.col("distinct_values").alias("_d"))
    median = t.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.percentile_approx(c, F.array(F.lit(0.44), F.lit(0.56)), 100_000).cast("array<double>").alias("_m")) for c in ("o_orderkey", "o_custkey")]).alias("a")).select(F.inline("a"))
    both = found.join(F.broadcast(exact), "column").join(F.broadcast(median), "column", "left")
    near = F.abs(F.col("distinct_values") - F.col("_d")) <= F.ceil(4 * states.DISTINCT_ERROR * F.col("_d"))
    between = F.col("quantiles").isNull() | F.col("quantiles")[0].between(F.col("_m")[0], F.col("_m")[1])
    return both.select("column", "rows", "nulls", "empty_strings", "numbers", F.round("most", 2).alias("most"), F.array_join("samples", ",").alias("samples"), (near & between).alias("near"))


@query("orders", "customer", sql="SELECT field, issue, rows FROM (SELECT 'o_custkey' AS field, 'null_values' AS issue, count(*) AS rows FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'status', 'empty_strings', count(*) FROM orders WHERE o_orderkey % 13 = 0) WHERE rows > 0")
def profile_issue_list(orders, customer):
    both = profile.profile_tables({"orders": bad_orders(orders), "customer": customer.select("c_custkey", "c_name")})
    return profile.profile_issues(both).select("field", "issue", "rows")


_M = "(o_orderkey % 11 > 0 AND o_custkey % 3 > 0)"


@query("orders", "customer", sql=f"""
WITH b AS ({_BAD}), j AS (SELECT b.*, coalesce(o_custkey % 3 > 0, false) AS m FROM b), i AS (
 SELECT o_orderkey, 'customer required' AS rule, 'rule' AS source, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value, m FROM j WHERE {_C}
 UNION ALL SELECT o_orderkey, 'status allowed', 'rule', 'status', status, m FROM j WHERE {_S}
 UNION ALL SELECT o_orderkey, 'date_parse_failed', 'detector', 'order_date', order_date, m FROM j WHERE {_D}
 UNION ALL SELECT o_orderkey, 'known customer', 'lookup', 'known', 'false', m FROM j WHERE NOT m)
SELECT o_orderkey, 'orders' AS source_table, source, rule, field, value, CASE WHEN m THEN 'customer' ELSE '' END AS hit_lookups, CASE WHEN m THEN '' ELSE 'customer' END AS failed_lookups FROM i""")
def audit_sources(orders, customer):
    """What found each issue: rules, a lookup, and a detector where no rule covers the field."""
    known = lookup.lookup(bad_orders(orders).drop("amount"), customer.where("c_custkey % 3 > 0").select("c_custkey", "c_name"), "o_custkey", "c_custkey", ["c_name"], order_by=["c_custkey"], match_field="known")
    made = [RULES[0], RULES[2], Rule("known customer", "known", "lookup_missing", reason="customer_not_found")]
    found = detect.detect(known.select("o_orderkey", "o_custkey", "status", "order_date", "known"), row_issues=False, keys=[])
    dates = F.filter(detect.as_issues(), lambda x: x["reason"].endswith(":date_parse_failed") | (x["field"] == "o_custkey"))
    return audit.record_audit(rules.apply_rules(found.withColumn("issues", dates).drop("findings"), made), ["o_orderkey"], made, {"customer": "known"}, "orders").select("o_orderkey", "source_table", "source", "rule", "field", "value", "hit_lookups", "failed_lookups")


@query("orders", sql="SELECT 'null_value' AS issue, 'missing' AS category, 'fill' AS action, count(*) AS rows FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'date_parse_failed', 'date', 'correct', count(*) FROM orders WHERE o_orderkey % 19 = 0")
def issues_with_vocabulary(orders):
    """What was found, with the category and advice of the vocabulary; kinds that were not found do not appear."""
    found = detect.issue_summary(detect.detect(bad_orders(orders).select("o_orderkey", "o_custkey", "order_date"), row_issues=False, keys=[]))
    told = detect.taxonomy(orders.sparkSession).select("issue", "category", "action")
    return found.join(told, "issue").where("issue in ('null_value', 'date_parse_failed')").select("issue", "category", "action", F.col("affected_rows").alias("rows"))


@query("nation", "region", sql="SELECT 'nation' AS tbl, CAST(n_nationkey AS VARCHAR) AS k, CASE n_regionkey WHEN 0 THEN 'line' || chr(10) || 'break, \"quoted\"' ELSE n_name END AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def files_to_tables(nation, region):
    """Tables written as CSV, found again as files, and read with what their bytes tell: line breaks, quotes and separators."""
    name = F.when(F.col("n_regionkey") == 0, 'line\nbreak, "quoted"').otherwise(F.col("n_name"))
    sides = {"nation": nation.select(F.col("n_nationkey").alias("k"), name.alias("name")), "region": region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))}
    folder = _folder(nation, "tables")
    tables.write_tables(sides, folder, "csv")
    found, inventory = tables.read_tables(nation.sparkSession, [folder])
    homes = {r["table"]: r["file"].rsplit("/", 2)[-2] for r in inventory.collect()}
    return reduce(DataFrame.unionByName, [df.select(F.lit(homes[t]).alias("tbl"), "k", "name") for t, df in found.items()])


@query("orders", sql="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partly filled' END AS meaning, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 END::BIGINT AS rank FROM orders")
def lookup_inline_records(orders):
    """A few records written in the job are the table that is looked up; what a record lacks is null."""
    words = tables.inline_table(orders.sparkSession, [{"status": "F", "meaning": "filled", "rank": 3}, {"status": "O", "meaning": "open", "rank": 1}, {"status": "P", "meaning": "partly filled"}])
    return lookup.lookup(orders, words, "o_orderstatus", "status", ["meaning", "rank"], order_by=["status"]).select("o_orderkey", "meaning", "rank")


@query("orders", sql="SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def earlier_result(orders):
    """One job writes its result, the next one reads it."""
    kept = orders.where("o_orderstatus = 'F'")
    path = tables.write_tables({"kept": kept}, _folder(kept, "results"))[0]
    out = summarize.summarize(tables.read_result(orders.sparkSession, path), ["o_orderpriority"], [summarize.Metric("count", output="orders"), summarize.Metric("sum", "o_totalprice", "total")])
    return out.withColumn("total", F.round("total", 2))


@query("orders", sql="SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def template_layout(orders):
    """The only table without rows is the layout that the result takes."""
    layout = reshape.template_schema({"layout": orders.where("false").select("o_orderkey", "o_custkey", "o_orderstatus"), "orders": orders})
    return orders.select(*layout)


@query("orders", sql="SELECT 'O_CUSTKEY' AS field, 'present' AS status, count(*) AS missing FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'status', 'present', count(*) FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'channel', 'missing', NULL")
def required_fields(orders):
    """Which required fields a table has, and how many of their cells are missing."""
    t = bad_orders(orders)
    report = rules.presence_report(orders.sparkSession, ["O_CUSTKEY", "status", "channel"], t.columns)
    gaps = analysis.missing_rates(t, ["o_custkey", "status"]).select(F.col("field").alias("_f"), "missing")
    return report.join(gaps, F.lower("field") == F.col("_f"), "left").select("field", "status", "missing")


@query("orders", sql="SELECT field, n AS missing FROM (SELECT 'o_orderkey' AS field, 0::BIGINT AS n UNION ALL SELECT 'o_custkey', count(*) FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'status', count(*) FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'amount', 0 UNION ALL SELECT 'order_date', 0)")
def critical_gaps(orders):
    """Gaps in the fields whose names say that they matter."""
    t = bad_orders(orders).withColumn("o_orderkey_note", F.lit(None).cast("string")).withColumnRenamed("o_orderkey_note", "remark")
    return analysis.missing_rates(t, profile.critical_fields(t.columns)).select("field", "missing")


@query("orders", "customer", sql="SELECT 'orders' AS base, o_orderkey AS k, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def detail_side_lookup(orders, customer):
    """Of two tables that share a key, the one in which it repeats is enriched from the other."""
    sides = {"orders": orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("k")), "customer": customer.select(F.col("c_custkey").alias("custkey"), "c_name")}
    r = profile.relationship(sides["customer"], "custkey", sides["orders"], "custkey").first()
    base = profile.detail_side("customer", not r["left_repeats"], "orders", not r["right_repeats"])
    other = "customer" if base == "orders" else "orders"
    return lookup.lookup(sides[base], sides[other], "custkey", "custkey", ["c_name"], order_by=["custkey"]).select(F.lit(base).alias("base"), "k", "c_name")


@query("orders", sql=f"SELECT o_orderkey, {_C} AS customer, {_S} OR o_orderkey % 13 = 0 AS status, {_A} AS amount FROM orders")
def rules_from_files(orders):
    """A schema and a Markdown table are written beside each other, read as rule documents, and applied."""
    spark = orders.sparkSession
    folder = _folder(orders, "rules")
    schema = '{"properties": {"status": {"enum": ["F", "O", "P"]}, "o_custkey": {"type": "integer"}}, "required": ["status"]}'
    spark.range(1, numPartitions=1).select(F.lit(schema)).write.mode("overwrite").text(f"{folder}/a")
    spark.range(1, numPartitions=1).select(F.lit("| field | rule |\n| --- | --- |\n| o_custkey | required |\n| amount | >= 0 |")).write.mode("overwrite").text(f"{folder}/b")
    made = rule_files.read_rules(spark, [folder], ["o_custkey", "amount"])
    marked = rules.apply_rules(bad_orders(orders), made)
    about = lambda f: F.exists("issues", lambda x: x["field"] == f)
    return marked.select("o_orderkey", about("o_custkey").alias("customer"), about("status").alias("status"), about("amount").alias("amount"))


_LABELLED = [Rule("customer required", "o_custkey", "is_blank", reason="incomplete", severity="error"), Rule("status allowed", "status", "not_in", values=("F", "O", "P"), reason="incomplete", severity="warn"), Rule("amount positive", "amount", "lt", 0, reason="amount", severity="error"), Rule("status twice", "status", "duplicated", severity="info")]
_HITS = f"""h AS (SELECT 'customer required' AS rule, 'incomplete' AS label, 'error' AS severity, 'o_custkey is_blank' AS condition, o_orderkey AS k FROM orders WHERE {_C}
 UNION ALL SELECT 'status allowed', 'incomplete', 'warn', 'status not_in F, O, P', o_orderkey FROM orders WHERE {_S} UNION ALL SELECT 'amount positive', 'amount', 'error', 'amount lt 0', o_orderkey FROM orders WHERE {_A}
 UNION ALL SELECT 'status twice', 'status twice', 'info', 'status duplicated', o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY status) AS n FROM ({_BAD})) WHERE n > 1)"""


@query("orders", sql=f"""
WITH {_HITS}, t AS (SELECT count(*) AS n FROM orders), d AS (SELECT DISTINCT 'label' AS part, label AS name, k FROM h UNION ALL SELECT 'rule', rule, k FROM h),
s AS (SELECT part, name, array_to_string(list(CAST(k AS VARCHAR) ORDER BY k)[1:10], ',') AS sample_keys FROM d GROUP BY 1, 2)
SELECT x.*, s.sample_keys FROM (
 SELECT 'rule' AS part, rule AS name, severity, condition, 1 AS rules, count(*) AS hits, count(*) AS rows, round(count(*) / any_value(t.n), 4) AS rate FROM h, t GROUP BY 2, 3, 4
 UNION ALL SELECT 'label', label, min(severity), CASE label WHEN 'incomplete' THEN 'o_custkey is_blank; status not_in F, O, P' ELSE min(condition) END, CAST(count(DISTINCT rule) AS INTEGER), count(*), count(DISTINCT k), round(count(DISTINCT k) / any_value(t.n), 4) FROM h, t GROUP BY 2) x JOIN s ON x.part = s.part AND x.name = s.name""")
def impact_by_rule_and_label(orders):
    """Hits, rates and the first keys of four rules and three labels, before any rule is applied."""
    return impact.impact(bad_orders(orders), _LABELLED, ["o_orderkey"]).withColumn("sample_keys", F.array_join("sample_keys", ","))


@query("orders", sql=f"""
WITH {_HITS}, l AS (SELECT k, string_agg(DISTINCT label, ';' ORDER BY label DESC) AS labels FROM h WHERE label <> 'status twice' GROUP BY 1)
SELECT labels, o_orderkey, o_custkey, status, round(amount, 2) AS amount FROM l JOIN ({_BAD}) ON k = o_orderkey ORDER BY o_orderkey LIMIT 20""")
def impact_labelled_rows(orders):
    """The first twenty rows that rules would label: a report to look at."""
    return impact.labelled_rows(bad_orders(orders).drop("order_date"), _LABELLED[:3], ["o_orderkey"]).withColumn("amount", F.round("amount", 2))


@query("orders", sql=f"SELECT unnest(['lookups', 'rules', 'labels', 'rows', 'labelled rows', 'rows with errors']) AS item, unnest([1, 3, 2, n, l, e]) AS count, unnest([NULL, NULL, NULL, NULL, round(l / n, 4), round(e / n, 4)]) AS rate FROM (SELECT count(*) AS n, count(CASE WHEN {_C} OR {_S} OR {_A} THEN 1 END) AS l, count(CASE WHEN {_C} OR {_A} THEN 1 END) AS e FROM orders)")
def impact_approval(orders):
    return impact.approval_list(bad_orders(orders), _LABELLED[:3], lookups=1)


@query("orders", "customer", sql=f"""
WITH b AS (SELECT b.*, o_orderpriority AS p, o_orderdate AS day FROM ({_BAD}) b JOIN orders o ON o.o_orderkey = b.o_orderkey), m AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS n FROM b GROUP BY 1),
i AS (SELECT p, reason, count(*) AS n FROM (SELECT o_orderkey, p, 'incomplete' AS reason FROM b WHERE {_C.replace("o_orderkey", "b.o_orderkey")} OR o_orderkey % 13 IN (0, 2) UNION ALL SELECT o_orderkey, p, 'amount' FROM b WHERE amount < 0) GROUP BY 1, 2),
k AS (SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT CASE WHEN o_custkey % 3 > 0 THEN o_custkey END) AS m FROM orders)
SELECT 'counts' AS topic, 'of ' || count(*) || ' rows ' || count(CASE WHEN NOT ({_C} OR {_A}) THEN 1 END) || ' are usable and ' || count(CASE WHEN {_C} OR {_A} THEN 1 END) || ' need review' AS finding FROM orders
UNION ALL SELECT 'groups', 'p is most often ' || p || ': ' || n || ' rows' FROM (SELECT p, count(*) AS n FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
UNION ALL SELECT 'numbers', printf('amount: %d numbers from %.2f to %.2f, total %.2f, mean %.2f, nine in ten up to %.2f', count(*), min(amount), max(amount), sum(amount), avg(amount), quantile_cont(amount, 0.9)) FROM b
UNION ALL SELECT 'trend', 'the last month, ' || max(month) || ', has ' || arg_max(n, month) || ' rows; most, ' || max(n) || ', are in ' || (SELECT month FROM m ORDER BY n DESC, month LIMIT 1) FROM m
UNION ALL (SELECT 'cross', p || ' has most rows with ' || reason || ': ' || n FROM i ORDER BY n DESC, p, reason LIMIT 1)
UNION ALL SELECT 'matches', 'o.custkey -> c.custkey matches the fewest keys: ' || m || ' of ' || n FROM k
UNION ALL SELECT 'points', printf('o_orderkey and amount: correlation %.2f in %d points', corr(o_orderkey, amount), count(*)) FROM (SELECT o_orderkey, amount FROM b ORDER BY o_orderkey LIMIT 200)""")
def findings_of_analysis(orders, customer):
    """The sentences of all tables that describe a result: counts, groups, numbers, trend, issues by group, matches, points."""
    t = orders.select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("day")).join(bad_orders(orders).drop("order_date"), "o_orderkey")
    keys = {"o": orders.select(F.col("o_custkey").alias("custkey")), "c": customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("custkey"))}
    relations = profile.relationships(keys).where("left_table = 'o'")
    made = analysis.analyse(rules.apply_rules(t, _LABELLED[:3]), "status", dimension="p", measures=["amount"], date="day", points=("o_orderkey", "amount"), order_by=["o_orderkey"], relations=relations)
    return made["findings"].where("topic not in ('status', 'missing', 'exceptions')").withColumn("finding", F.regexp_replace("finding", r" \([0-9.]+ %\)", ""))
