"""Queries over predicates, formulas, numbers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formulas import Formula, formula
from ..functions.predicates import OPS, Condition, condition, filter_rows
from ..functions.text import normalize_key, number, parse_date, time_bucket, to_number
from ..operators import rows, summarize
from .base import registry

REGISTERED, query = registry()

#: orders with a text amount in several notations, and blanks.
_AMOUNT = """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '(' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || ')'
 WHEN 3 THEN ' ' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || ' ' WHEN 4 THEN '¥' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
 WHEN 5 THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || '%' ELSE 'n/a' END"""
_VALUE = "CASE o_orderkey % 7 WHEN 2 THEN -CAST(o_totalprice AS BIGINT) WHEN 3 THEN CAST(o_totalprice AS BIGINT) WHEN 4 THEN CAST(o_totalprice AS BIGINT) WHEN 5 THEN CAST(o_totalprice AS BIGINT) END"


def with_amount(orders):
    """What ``_AMOUNT`` says, with whole numbers rounded as DuckDB's cast does."""
    n = F.bround("o_totalprice", 0).cast("bigint").cast("string")
    k = F.col("o_orderkey") % 7
    shown = (
        F.when(k == 0, F.lit(None)).when(k == 1, "  ").when(k == 2, F.concat(F.lit("("), n, F.lit(")"))).when(k == 3, F.concat(F.lit(" "), n, F.lit(" ")))
        .when(k == 4, F.concat(F.lit("¥"), n)).when(k == 5, F.concat(n, F.lit("%"))).otherwise("n/a")
    )
    return orders.withColumn("amount", shown)


@query("orders", "customer", "nation", sql=f"""
SELECT n_name, count(*) AS orders, coalesce(sum({_VALUE}), 0)::DOUBLE AS amount_sum FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def business_number_total(orders, customer, nation):
    """Totals of a text amount per nation; the detail keeps its text."""
    joined = with_amount(orders).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "amount")
    return summarize.summarize(joined, ["n_name"], [summarize.Metric("count", output="orders"), summarize.Metric("sum", "amount", "amount_sum")])


@query("orders", sql=f"""
SELECT o_orderkey, v::DOUBLE AS business, CASE WHEN o_orderkey % 7 = 3 THEN v END::DOUBLE AS plain FROM (SELECT o_orderkey, {_VALUE} AS v FROM orders)""")
def number_readings(orders):
    return with_amount(orders).select("o_orderkey", number(F.col("amount"), "business").alias("business"), number(F.col("amount"), "plain").alias("plain"))


_DIRTY = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || o_orderpriority || ' ' WHEN 3 THEN lower(o_orderpriority) ELSE CAST(o_custkey AS VARCHAR) END AS s, o_orderkey % 3 = 0 AS flag FROM orders"
_T, _BLANK, _NUM = "lower(trim(coalesce(s, '')))", "coalesce(trim(s) = '', true)", "try_cast(trim(s) AS DOUBLE)"


def dirty_priority(orders):
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).when(k == 3, F.lower("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", s.alias("s"), (F.col("o_orderkey") % 3 == 0).alias("flag"))


@query("orders", sql=f"""
WITH d AS ({_DIRTY}), n AS (SELECT s AS k, count(*) AS n FROM d GROUP BY s)
SELECT o_orderkey, {_BLANK} AS is_blank, NOT {_BLANK} AS not_blank, s IS NULL AS is_null, s IS NOT NULL AS not_null, n > 1 AS duplicated, NOT flag AS lookup_missing,
 NOT {_BLANK} AND {_NUM} IS NULL AS numeric_invalid, NOT {_BLANK} AS date_invalid, {_T} = '1-urgent' AS "equals", {_T} <> '1-urgent' AS not_equals,
 contains({_T}, 'high') AS contains, NOT contains({_T}, 'high') AS not_contains, regexp_matches({_T}, '^(?:[0-9]-)') AS regex_match,
 NOT {_BLANK} AND NOT regexp_matches({_T}, '^(?:[0-9]-)') AS regex_not_match, {_T} IN ('1-urgent', '5-low') AS "in", {_T} NOT IN ('1-urgent', '5-low') AS not_in,
 coalesce({_NUM} > 100, false) AS gt, coalesce({_NUM} >= 100, false) AS gte, coalesce({_NUM} < 100, false) AS lt, coalesce({_NUM} <= 100, false) AS lte
FROM d JOIN n ON d.s IS NOT DISTINCT FROM n.k""")
def predicates_all_ops(orders):
    d = dirty_priority(orders)
    what = {"equals": {"value": "1-URGENT"}, "not_equals": {"value": "1-URGENT"}, "contains": {"value": "HIGH"}, "not_contains": {"value": "HIGH"}, "regex_match": {"value": "[0-9]-"}, "regex_not_match": {"value": "[0-9]-"}, "in": {"values": ("1-URGENT", "5-low")}, "not_in": {"values": ("1-URGENT", "5-low")}} | {k: {"value": 100} for k in ("gt", "gte", "lt", "lte")}
    return d.select("o_orderkey", *[condition(Condition("flag" if op == "lookup_missing" else "s", op, **what.get(op, {})), d.columns).alias(op) for op in OPS])


@query("orders", sql=f"SELECT o_orderkey, s FROM ({_DIRTY}) WHERE NOT coalesce({_NUM} < 100, false)")
def filter_negate_keeps_unevaluable(orders):
    return filter_rows(dirty_priority(orders), Condition("s", "lt", 100), exclude=True).select("o_orderkey", "s")


@query("orders", sql=f"SELECT s, count(*) AS rows FROM ({_DIRTY}) WHERE NOT {_BLANK} AND flag GROUP BY s")
def filter_all_conditions(orders):
    return filter_rows(dirty_priority(orders), Condition("s", "not_blank"), Condition("flag", "equals", "true")).groupBy("s").agg(F.count(F.lit(1)).alias("rows"))


def _apply(df, key, *formulas):
    return rows.apply_formulas(df, formulas).select(key, *[f.output for f in formulas])


@query("part", sql="""
SELECT p_partkey, trim('  ' || p_name || ' ') AS trim, upper(p_name) AS upper, lower(p_brand) AS lower, p_brand || '/' || p_type AS concat, left(p_name, 3) AS "left", right(p_name, 4) AS "right",
 substring(p_name, 2, 3) AS mid, length(p_name) AS len, replace(p_brand, 'Brand', 'B') AS substitute, substring(p_brand, 1, 1) || 'XY' || substring(p_brand, 4) AS "replace",
 coalesce(split_part(p_brand, '#', 2), '') AS "split", regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g') AS plain, p_brand || ',' || p_type AS textjoin FROM part""")
def formulas_text(part):
    padded = part.withColumn("padded", F.concat(F.lit("  "), "p_name", F.lit(" "))).withColumn("empty", F.lit(""))
    return _apply(
        padded, "p_partkey", Formula("trim", "trim", "padded"), Formula("upper", "upper", "p_name"), Formula("lower", "lower", "p_brand"), Formula("concat", "concat", columns=["p_brand", "p_type"], sep="/"),
        Formula("left", "left", "p_name", value=3), Formula("right", "right", "p_name", value=4), Formula("mid", "mid", "p_name", values=[2, 3]), Formula("len", "len", "p_name"),
        Formula("substitute", "substitute", "p_brand", values=["Brand", "B"]), Formula("replace", "replace", "p_brand", values=[2, 2], value="XY"), Formula("split", "split", "p_brand", sep="#", value=1, default=""),
        Formula("plain", "remove_special_chars", "p_name"), Formula("textjoin", "textjoin", columns=["p_brand", "empty", "p_type"], sep=","),
    )


@query("part", sql="""
SELECT p_partkey, round(p_retailprice + p_size, 4) AS "add", round(p_retailprice - p_size, 4) AS subtract, round(p_retailprice * p_size, 4) AS multiply, round(p_retailprice / nullif(p_size % 5, 0), 4) AS divide,
 round_even(p_retailprice, 1) AS "round", ceil(p_retailprice) AS roundup, floor(p_retailprice * 10) / 10 AS rounddown, abs(p_size - 25)::DOUBLE AS "abs",
 CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS bucket FROM part""")
def formulas_math(part):
    p = part.withColumn("rest", F.col("p_size") % 5).withColumn("away", F.col("p_size") - 25)
    out = _apply(
        p, "p_partkey", Formula("add", "add", columns=["p_retailprice", "p_size"]), Formula("subtract", "subtract", columns=["p_retailprice", "p_size"]), Formula("multiply", "multiply", columns=["p_retailprice", "p_size"]),
        Formula("divide", "divide", columns=["p_retailprice", "rest"]), Formula("round", "round", "p_retailprice", value=1), Formula("roundup", "roundup", "p_retailprice", value=0), Formula("rounddown", "rounddown", "p_retailprice", value=1),
        Formula("abs", "abs", "away"), Formula("bucket", "bucket", "p_size", values=[10, 30], mapping={10: "small", 30: "medium"}, default="large"),
    )
    return out.select("p_partkey", *[F.round(c, 4).alias(c) for c in ("add", "subtract", "multiply", "divide")], "round", F.col("roundup").cast("double").alias("roundup"), "rounddown", "abs", "bucket")


@query("orders", sql=f"""
WITH d AS ({_DIRTY}) SELECT o_orderkey, CASE WHEN {_BLANK} THEN 'none' ELSE 'some' END AS if_else,
 CASE WHEN {_BLANK} THEN 'blank' WHEN {_NUM} > 100 THEN 'high' ELSE 'rest' END AS ifs, NOT {_BLANK} AND coalesce({_NUM} > 100, false) AS both, {_BLANK} OR coalesce({_NUM} > 100, false) AS either,
 NOT {_BLANK} AS negated, coalesce(CASE WHEN NOT {_BLANK} THEN s END, 'default') AS "coalesce", CASE s WHEN '1-urgent' THEN 'now' WHEN '5-low' THEN 'later' ELSE 'other' END AS mapped,
 coalesce(s, '') IN ('', '1-urgent') AS isin, coalesce(trim(s) = '2-HIGH', false) AS equals FROM d""")
def formulas_logic(orders):
    blank, high = Condition("s", "is_blank"), Condition("s", "gt", 100)
    return _apply(
        dirty_priority(orders), "o_orderkey", Formula("if_else", "if_else", conditions=[blank], true_value="none", false_value="some"), Formula("ifs", "ifs", conditions=[blank, high], values=["blank", "high"], default="rest"),
        Formula("both", "and", conditions=[Condition("s", "not_blank"), high]), Formula("either", "or", conditions=[blank, high]), Formula("negated", "not", conditions=[blank]), Formula("coalesce", "coalesce", columns=["s"], default="default"),
        Formula("mapped", "map", "s", mapping={"1-urgent": "now", "5-low": "later"}, default="other"), Formula("isin", "isin", "s", values=["", "1-urgent"]), Formula("equals", "equals", "s", value="2-HIGH"),
    )


@query("orders", sql="""
SELECT o_orderkey, year(o_orderdate)::INT AS "year", month(o_orderdate)::INT AS "month", day(o_orderdate)::INT AS "day", strftime(o_orderdate, '%Y/%m/%d') AS shown,
 date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')::DOUBLE AS days, date_diff('hour', o_orderdate, TIMESTAMP '2000-01-01')::DOUBLE AS hours, o_orderkey % 4 = 3 AS unread FROM orders""")
def formulas_date(orders):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = orders.withColumn("d", F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))).withColumn("odd", F.when(k == 3, F.lit("13/45/2020")).otherwise(F.col("d")))
    fs = [Formula("year", "year", "d"), Formula("month", "month", "d"), Formula("day", "day", "d"), Formula("shown", "text", "d", value="yyyy/mm/dd"), Formula("days", "date_diff", "d", value="2000-01-01 00:00:00", default="days"), Formula("hours", "date_diff", "d", value="2000-01-01 00:00:00", default="hours")]
    return t.select("o_orderkey", *[formula(f, t.columns).alias(f.output) for f in fs], condition(Condition("odd", "date_invalid"), t.columns).alias("unread"))


@query("part", sql=r"""
SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9]?)', 1) AS extracted, CASE WHEN regexp_matches(p_name, 'q+') THEN regexp_extract(p_name, '(q+)', 1) ELSE 'none' END AS missing,
 regexp_replace(p_type, '[AEIOU]', '_', 'g') AS replaced, regexp_matches(p_type, 'STEEL|BRASS') AS found FROM part""")
def formulas_regex(part):
    return _apply(part, "p_partkey", Formula("extracted", "regex_extract", "p_brand", value="([0-9])([0-9]?)", values=[0]), Formula("missing", "regex_extract", "p_name", value="(q+)", values=[0], default="none"), Formula("replaced", "regex_replace", "p_type", value="[AEIOU]", default="_"), Formula("found", "contains", "p_type", value="STEEL|BRASS"))


@query("part", sql="""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bad' WHEN 1 THEN 'bad' WHEN 2 THEN 'bad' ELSE p_brand END AS iferror, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 2 THEN 'none' WHEN 1 THEN '#DIV/0!' ELSE p_brand END AS ifna,
 CASE p_partkey % 4 WHEN 3 THEN p_brand ELSE coalesce(CASE p_partkey % 4 WHEN 0 THEN '#N/A' WHEN 1 THEN '#DIV/0!' END, '') END AS width FROM part""")
def formulas_errors(part):
    k = F.col("p_partkey") % 4
    p = part.withColumn("e", F.when(k == 0, "#N/A").when(k == 1, "#DIV/0!").when(k == 2, F.lit(None)).otherwise(F.col("p_brand"))).withColumn("w", F.concat(F.lit("​　"), "e"))
    return _apply(p.withColumn("w", F.when(F.col("e").isNull(), F.lit("　")).otherwise(F.col("w"))), "p_partkey", Formula("iferror", "iferror", "e", default="bad"), Formula("ifna", "ifna", "e", default="none"), Formula("width", "normalize_width", "w"))


def _bucket(unit, sql):
    @query("orders", sql=f"SELECT {sql} AS bucket, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
    def made(orders):
        b = time_bucket(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")), unit)
        return orders.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    REGISTERED[f"time_bucket_{unit}"] = REGISTERED.pop("made")


for _unit, _sql in {"month": "strftime(o_orderdate, '%Y-%m')", "quarter": "year(o_orderdate) || '-Q' || quarter(o_orderdate)", "year": "CAST(year(o_orderdate) AS VARCHAR)", "week": "isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0')"}.items():
    _bucket(_unit, f"CASE WHEN o_orderkey % 10 = 0 THEN '(no date)' ELSE {_sql} END")


@query("supplier", sql="SELECT s_suppkey, lower(trim(s_name)) AS k, try_cast(s_name AS DOUBLE) IS NOT NULL AS numeric FROM supplier")
def normalized_keys(supplier):
    wide = F.translate("s_name", "#0123456789", "＃０１２３４５６７８９")
    return supplier.select("s_suppkey", normalize_key(F.concat(F.lit("　"), wide, F.lit(" "))).alias("k"), to_number(F.col("s_name")).isNotNull().alias("numeric"))


@query("events", sql="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def dates_in_five_layouts(events):
    k, t = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    s = F.when(k == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(t, "yyyy/M/d HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
    return events.select("event_id", F.date_format(parse_date(s), "yyyy-MM-dd HH:mm:ss").alias("shown"))


_LAYOUTS = """CASE event_id % 12 WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M:%S.%g') WHEN 2 THEN strftime(t, '%Y/%-m/%-d %H:%M') WHEN 3 THEN strftime(t, '%Y-%m')
 WHEN 4 THEN strftime(t, '%b %-d, %Y') WHEN 5 THEN strftime(t, '%-d %B %Y') WHEN 6 THEN strftime(t, '%d-%b-%Y') WHEN 7 THEN strftime(t, '%Y%m%dT%H%M%S') WHEN 8 THEN strftime(t, '%Y年%-m月%-d日')
 WHEN 9 THEN strftime(t, '%-m/%-d/%Y %H:%M') WHEN 10 THEN strftime(t + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '+05:00' ELSE strftime(t, '%Y.%m.%d') || ' no' END"""


@query("events", sql=f"""
SELECT event_id, {_LAYOUTS} AS shown, strftime(CASE event_id % 12 WHEN 0 THEN date_trunc('second', t) WHEN 1 THEN date_trunc('millisecond', t) WHEN 2 THEN date_trunc('minute', t) WHEN 3 THEN date_trunc('month', t)
 WHEN 7 THEN date_trunc('second', t) WHEN 9 THEN date_trunc('minute', t) WHEN 10 THEN date_trunc('second', t) WHEN 11 THEN NULL ELSE date_trunc('day', t) END, '%Y-%m-%d %H:%M:%S.%g') AS read
FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM events)""")
def date_layouts(events):
    """Times written in eleven layouts, and a text that is none, read back as far as each layout goes."""
    t, way = F.col("ts").cast("timestamp"), F.col("event_id") % 12
    write = lambda pattern, t=t: F.date_format(t, pattern)
    made = [
        write("yyyy-MM-dd'T'HH:mm:ss'Z'"), write("yyyy-MM-dd HH:mm:ss.SSS"), write("yyyy/M/d HH:mm"), write("yyyy-MM"), write("MMM d, yyyy"), write("d MMMM yyyy"), write("dd-MMM-yyyy"),
        write("yyyyMMdd'T'HHmmss"), write("yyyy年M月d日"), write("M/d/yyyy HH:mm"), F.concat(write("yyyy-MM-dd'T'HH:mm:ss", t + F.expr("interval 5 hours")), F.lit("+05:00")), F.concat(write("yyyy.MM.dd"), F.lit(" no")),
    ]
    shown = F.coalesce(*[F.when(way == i, x) for i, x in enumerate(made)])
    return events.select("event_id", shown.alias("shown")).withColumn("read", F.date_format(parse_date(F.col("shown")), "yyyy-MM-dd HH:mm:ss.SSS"))
