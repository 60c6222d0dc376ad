"""Queries over summaries, ranks, duplicates and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import Condition
from ..operators import reshape, rows, summarize
from ..operators.summarize import Metric
from .base import registry
from .scalars import with_amount

REGISTERED, query = registry()


@query("lineitem", sql="""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS least, max(l_tax) AS most,
 round(median(l_extendedprice), 4) AS middle, count(DISTINCT l_partkey) AS parts, arg_min(l_partkey, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber) AS first, arg_max(l_partkey, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber) AS last FROM lineitem GROUP BY 1, 2""")
def summary_all_aggs(lineitem):
    ms = [Metric("count", output="n"), Metric("sum", "l_quantity", "total"), Metric("mean", "l_extendedprice", "mean"), Metric("min", "l_discount", "least"), Metric("max", "l_tax", "most"), Metric("median", "l_extendedprice", "middle"), Metric("nunique", "l_partkey", "parts"), Metric("first", "l_partkey", "first"), Metric("last", "l_partkey", "last")]
    order = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    out = summarize.aggregate(lineitem, ["l_returnflag", "l_linestatus"], ms, [order])
    return out.select("l_returnflag", "l_linestatus", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "least", "most", F.round("middle", 4).alias("middle"), "parts", "first", "last")


@query("lineitem", sql="SELECT count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue FROM lineitem")
def grand_total(lineitem):
    return summarize.aggregate(lineitem, [], [Metric("count", output="lines"), Metric("sum", "l_extendedprice", "revenue")]).withColumn("revenue", F.round("revenue", 2))



@query("orders", sql=f"SELECT o_orderpriority, {', '.join(f'round(coalesce(sum(CASE WHEN o_orderstatus = {chr(39)}{s}{chr(39)} THEN o_totalprice END), 0), 2) AS {s}' for s in 'FOP')} FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus <> 'P' GROUP BY 1")
def crosstab_sum(orders):
    out = summarize.crosstab(orders.where("o_orderkey % 2 = 0 OR o_orderstatus <> 'P'"), ["o_orderpriority"], "o_orderstatus", Metric("sum", "o_totalprice"))
    return out.select("o_orderpriority", *[F.round(s, 2).alias(s) for s in "FOP"])


@query("orders", sql=f"SELECT o_orderpriority, {', '.join(f'count(CASE WHEN o_orderstatus = {chr(39)}{s}{chr(39)} THEN 1 END) AS {s}' for s in 'FOP')} FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def crosstab_count(orders):
    kept = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")))
    return summarize.crosstab(kept, ["o_orderpriority"], "o_orderstatus", Metric("count"), values=list("FOP"))


@query("orders", sql="SELECT 'amount' AS measure, count(*) AS unreadable FROM orders WHERE o_orderkey % 7 = 6")
def unreadable_measures(orders):
    return summarize.unreadable(with_amount(orders), ["amount"])


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n_overall(orders):
    return summarize.top_rows(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@query("orders", sql="SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def top_n_within_group(orders):
    return summarize.top_rows(orders.select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_totalprice", 5, ["o_orderkey"], ["o_orderpriority"])


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25) AS returned, (SELECT round(sum(l_quantity), 2) FROM lineitem WHERE l_returnflag = 'R') AS quantity FROM lineitem""")
def countif_sumif_broadcast(lineitem):
    r = Condition("l_returnflag", "equals", "R")
    out = rows.conditional_totals(lineitem, {"returned": (None, [r, Condition("l_quantity", "gt", 25)]), "quantity": ("l_quantity", [r])})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "returned", F.round("quantity", 2).alias("quantity"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 > 0 THEN dense_rank() OVER (ORDER BY CASE WHEN l_linenumber % 5 > 0 THEN l_quantity END DESC NULLS LAST) END::INT AS place FROM lineitem")
def dense_rank_global(lineitem):
    q = lineitem.withColumn("q", F.when(F.col("l_linenumber") % 5 > 0, F.col("l_quantity")))
    return rows.dense_rank(q, "place", "q").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("orders", sql="SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate)::INT AS place FROM orders")
def dense_rank_partition(orders):
    return rows.dense_rank(orders.withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")), "place", "d", ["o_orderpriority"], descending=False).select("o_orderkey", "place")


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (ORDER BY l_quantity DESC) <= 3 AS top FROM lineitem")
def top_n_flag(lineitem):
    return rows.top_n_flag(lineitem, "top", "l_quantity", 3).select("l_orderkey", "l_linenumber", "l_partkey", "top")


@query("events", sql="SELECT event_id, last_value(CASE WHEN event_id % 7 = 3 THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def fill_down(events):
    e = events.select("event_id", F.when(F.col("event_id") % 7 == 3, F.col("event_type")).alias("t"))
    return rows.fill_down(e, "filled", "t", ["event_id"]).select("event_id", "filled")


@query("events", sql="SELECT event_id, last_value(CASE WHEN event_id % 7 = 3 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def fill_down_partition(events):
    e = events.select("event_id", "user_id", F.when(F.col("event_id") % 7 == 3, F.col("event_type")).alias("t"))
    return rows.fill_down(e, "filled", "t", ["event_id"], ["user_id"]).select("event_id", "filled")


def _dedupe(keep, order):
    @query("events", sql=f"SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY {order}) = 1")
    def made(events):
        e = events.select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
        return rows.dedupe(e, ["user_id", "event_type"], keep, ["event_id"], "t").select("event_id", "user_id", "event_type")

    REGISTERED[f"dedupe_{keep}"] = REGISTERED.pop("made")


for _k, _o in {"first": "event_id", "last": "event_id DESC", "latest": "date_trunc('second', ts) DESC, event_id", "earliest": "date_trunc('second', ts), event_id"}.items():
    _dedupe(_k, _o)


@query("events", sql="SELECT event_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) > 1")
def dedupe_all_duplicates(events):
    return rows.dedupe(events, ["user_id", "event_type"], "all_duplicates").select("event_id")


@query("lineitem", sql="SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedupe_whole_row(lineitem):
    return rows.dedupe(lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))


@query("part", sql="""
WITH k AS (SELECT p_brand, arg_min(p_type, p_partkey) AS t FROM part WHERE p_brand IS NOT NULL GROUP BY 1) SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN k.t END, 'none') AS kind FROM part LEFT JOIN k USING (p_brand)""")
def xlookup(part):
    p = part.withColumn("asked", F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(" "), "p_brand")).otherwise("nothing"))
    return rows.xlookup(p, "kind", "asked", "p_brand", "p_type", "none", ["p_partkey"]).select("p_partkey", "kind")


@query("lineitem", sql="""
SELECT l_orderkey, l_partkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (amount FOR measure IN (l_quantity, l_discount, l_tax))""")
def unpivot(lineitem):
    q = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))
    return reshape.unpivot(lineitem.select("l_orderkey", "l_partkey", "l_linenumber", q.alias("l_quantity"), "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("orders", sql="SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, CASE WHEN contains(o_orderpriority, '-') THEN split_part(o_orderpriority, '-', 2) ELSE '' END AS name FROM orders")
def split_columns(orders):
    sep, parts = reshape.infer_separator(orders, "o_orderpriority")
    return reshape.split_column(orders, "o_orderpriority", sep, parts, ["rank", "name"]).select("o_orderkey", "rank", "name")


@query("orders", sql="SELECT '-' AS separator, 2::INT AS parts FROM orders LIMIT 1")
def infer_separator(orders):
    sep, parts = reshape.infer_separator(orders, "o_orderpriority")
    return orders.limit(1).select(F.lit(sep).alias("separator"), F.lit(parts).alias("parts"))


@query("orders", sql="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus_mapped FROM orders")
def value_map(orders):
    return reshape.map_values(orders, "o_orderstatus", {"F": "finished", "O": "open"}).select("o_orderkey", "o_orderstatus_mapped")


@query("customer", sql="SELECT c_name, '' AS region, c_custkey FROM customer")
def project_schema(customer):
    return reshape.project(customer, ["c_name", "region", "c_custkey"])


@query("customer", sql="SELECT c_custkey AS \"C CustKey\", c_name AS \"c-name\", '' AS phone, 'ready' AS import_status, '' AS import_reason FROM customer")
def import_view(customer):
    return reshape.import_view(customer, ["C CustKey", "c-name", "phone"])[0].toDF("C CustKey", "c-name", "phone", "import_status", "import_reason")


@query("conversations", sql="SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') THEN 1 ELSE 0 END AS masked FROM conversations")
def mask_sensitive(conversations):
    out = reshape.mask_sensitive(conversations.withColumn("shown", F.col("text")), columns=[])
    return out.select("conv_id", "turn", "role", F.when(F.col("shown").rlike("^<(text|email|digits)"), 1).otherwise(0).alias("masked"))


@query("customer", sql="SELECT c_custkey, '<text:length=' || length(c_name) || ',letters=' || length(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) || ',digits=' || length(regexp_replace(c_name, '[^0-9]', '', 'g')) || '>' AS c_name FROM customer")
def mask_by_name(customer):
    return reshape.mask_sensitive(customer, columns=["c_name"]).select("c_custkey", "c_name")


@query("part", sql="SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '-50' WHEN 2 THEN '''@' || p_name ELSE p_name END AS note FROM part")
def neutralize_formulas(part):
    k = F.col("p_partkey") % 4
    note = F.when(k == 0, F.concat(F.lit("="), "p_name")).when(k == 1, "-50").when(k == 2, F.concat(F.lit("@"), "p_name")).otherwise(F.col("p_name"))
    return reshape.neutralize_formulas(part.select("p_partkey", note.alias("note")))


@query("orders", sql="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'rest' END AS _source_table FROM orders")
def union_with_origin(orders):
    return reshape.union_with_origin({"done": orders.where("o_orderstatus = 'F'"), "rest": orders.where("o_orderstatus <> 'F'")}).select("o_orderkey", "_source_table")


@query("orders", sql="SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate_month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY round(sum(o_totalprice), 2) DESC, 1 LIMIT 10")
def summarize_bucket_top(orders):
    out = summarize.summarize(orders.select("o_orderdate", "o_totalprice"), [], [Metric("sum", "o_totalprice", "total")], bucket=("o_orderdate", "month"), top_n=10)
    return out.withColumn("total", F.round("total", 2))


@query("orders", sql="SELECT unnest(['o_orderkey', 'note', 'o_orderstatus']) AS column, unnest([false, true, false]) AS blank")
def blank_columns(orders):
    return reshape.blank_columns(orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "  ").alias("note"), "o_orderstatus"))
