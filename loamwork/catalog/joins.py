"""Queries over lookups, roll-ups, metric views and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from ..operators import profile as P
from ..operators.summarize import Metric
from .base import registry

REGISTERED, query = registry()

_KEYED = "SELECT *, CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'x' || o_custkey WHEN 3 THEN ' ' || o_custkey || ' ' ELSE CAST(o_custkey AS VARCHAR) END AS k FROM orders"


def keyed(orders):
    k, c = F.col("o_orderkey") % 10, F.col("o_custkey").cast("string")
    return orders.withColumn("k", F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, F.concat(F.lit("x"), c)).when(k == 3, F.concat(F.lit(" "), c, F.lit(" "))).otherwise(c))


def _mode(mode, left, right):
    @query("orders", "customer", sql=f"""
    SELECT o.o_orderkey, c.c_name AS customer, c.c_custkey IS NOT NULL AS found FROM ({_KEYED}) o LEFT JOIN customer c ON {left} = {right} AND coalesce(trim(o.k), '') <> ''""")
    def made(orders, customer):
        c = customer.withColumn("ck", F.col("c_custkey").cast("string"))
        if mode == "case_insensitive":
            c = c.withColumn("ck", F.concat(F.lit("X"), "ck"))
        return L.lookup(keyed(orders), c, "k", "ck", ["c_name"], aliases={"c_name": "customer"}, mode=mode, order_by=["c_custkey"], match_field="found").select("o_orderkey", "customer", "found")

    REGISTERED[f"lookup_{mode}"] = REGISTERED.pop("made")


for _m, _l, _r in (("exact", "o.k", "CAST(c.c_custkey AS VARCHAR)"), ("trim", "trim(o.k)", "CAST(c.c_custkey AS VARCHAR)"), ("case_insensitive", "lower(o.k)", "'x' || c.c_custkey"), ("normalized_exact", "lower(trim(o.k))", "CAST(c.c_custkey AS VARCHAR)")):
    _mode(_m, _l, _r)


@query("lineitem", "lineitem", sql="""
WITH r AS (SELECT l_orderkey, l_linenumber, arg_min(l_returnflag, l_partkey * 1000000 + l_suppkey) AS flag FROM lineitem GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CASE WHEN l.l_linenumber % 3 > 0 THEN r.flag END AS flag FROM lineitem l LEFT JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber""")
def lookup_composite_key(lineitem, again):
    left = lineitem.withColumn("n", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber")))
    return L.lookup(left, again, ["l_orderkey", "n"], ["l_orderkey", "l_linenumber"], ["l_returnflag"], aliases={"l_returnflag": "flag"}, order_by=[F.col("l_partkey") * 1000000 + F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag")


@query("supplier", "nation", sql="SELECT s_suppkey, s_name, n_name AS s_name_lookup FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_suffix(supplier, nation):
    return L.lookup(supplier, nation.withColumnRenamed("n_name", "s_name"), "s_nationkey", "n_nationkey", ["s_name"], order_by=["n_nationkey"]).select("s_suppkey", "s_name", "s_name_lookup")


def _policy(policy, value, more=""):
    @query("customer", "orders", sql=f"""
    WITH r AS (SELECT o_custkey AS k, {value} AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey, r.v AS v, r.n IS NOT NULL AS found, coalesce(r.n > 1, false) AS several{more} FROM customer LEFT JOIN r ON c_custkey = r.k""")
    def made(customer, orders):
        field = {"first": "o_orderpriority", "review": "o_orderpriority", "list": "o_orderstatus", "aggregate": "o_totalprice"}[policy]
        out = L.lookup(customer, orders, "c_custkey", "o_custkey", [field], aliases={field: "v"}, policy=policy, order_by=["o_orderkey"], sep=",", match_field="found", ambiguity_field="several", confidence_field="confidence", explanation_field="why")
        if policy == "aggregate":
            out = out.withColumn("v", F.round("v", 2))
        return out.select("c_custkey", "v", "found", "several", *(["confidence", "why"] if policy == "review" else []))

    REGISTERED[f"lookup_dup_{policy}"] = REGISTERED.pop("made")


_policy("first", "arg_min(o_orderpriority, o_orderkey)")
_policy("list", "(SELECT string_agg(s, ',' ORDER BY f) FROM (SELECT o2.o_orderstatus AS s, min(o2.o_orderkey) AS f FROM orders o2 WHERE o2.o_custkey = orders.o_custkey GROUP BY 1))")
_policy("aggregate", "round(sum(o_totalprice), 2)")
_policy("review", "arg_min(o_orderpriority, o_orderkey)", ", CASE WHEN r.n IS NULL THEN 0.0 WHEN r.n > 1 THEN 0.65 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN r.n IS NULL THEN 'no match' WHEN r.n > 1 THEN 'several matches, first taken for review' ELSE 'matched' END AS why")


@query("part", sql="""
SELECT min(p_partkey) AS key, substr(p_name, 1, 3) || '~' || substr(p_name, 5) AS typed, CASE WHEN length(p_name) >= 7 THEN p_name END AS p_name, length(p_name) >= 7 AS found,
 CASE WHEN length(p_name) >= 7 THEN round((length(p_name) - 1.0) / length(p_name), 6) ELSE 0.0 END AS confidence FROM part GROUP BY part.p_name""")
def lookup_fuzzy(part):
    """Part names with one character changed, looked up among the true ones; held against a brute-force scan in the tests."""
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("key"))
    typed = names.select("key", F.concat(F.substring("p_name", 1, 3), F.lit("~"), F.substring("p_name", 5, 200)).alias("typed"))
    return L.lookup(typed, names, "typed", "p_name", ["p_name"], mode="fuzzy", order_by=["key"], match_field="found", confidence_field="confidence").select("key", "typed", "p_name", "found", F.round("confidence", 6).alias("confidence"))


@query("customer", sql="SELECT c_custkey, c_custkey AS found, 'Customer#' || right(c_name, 9) AS c_name, round(34.0 / 35, 6) AS confidence, 'similar key' AS explanation FROM customer")
def lookup_fuzzy_prefix(customer):
    """Names that all begin alike, one character lost: the one that differs in nothing else is found."""
    typed = customer.select("c_custkey", F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Custmer")).alias("typed"))
    true = customer.select(F.col("c_custkey").alias("found"), "c_name")
    out = L.lookup(typed, true, "typed", "c_name", ["found", "c_name"], mode="fuzzy", order_by=["found"], confidence_field="confidence", explanation_field="explanation")
    return out.select("c_custkey", "found", "c_name", F.round("confidence", 6).alias("confidence"), "explanation")


def _roll(name, metric, sql, fill=0):
    @query("customer", "orders", sql=f"SELECT c_custkey, {sql} AS v FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 4 > 0) ON c_custkey = o_custkey GROUP BY 1")
    def made(customer, orders):
        out = L.rollup(customer, orders.where("o_custkey % 4 > 0"), "c_custkey", "o_custkey", metric, fill)
        return out.select("c_custkey", "v" if metric.op == "count" else F.round("v", 5 if metric.op == "mean" else 2).alias("v"))

    REGISTERED[name] = REGISTERED.pop("made")


_roll("rollup_sum", Metric("sum", "o_totalprice", "v"), "round(coalesce(sum(o_totalprice), 0), 2)")
_roll("rollup_count_zero_fill", Metric("count", output="v"), "count(o_orderkey)")
_roll("rollup_mean", Metric("mean", "o_totalprice", "v"), "round(avg(o_totalprice), 5)", None)


@query("lineitem", "orders", "customer", "nation", sql="""
SELECT n_name AS nation, o_orderstatus AS status, round(sum(l_extendedprice), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def metric_query(lineitem, orders, customer, nation):
    view = L.MetricView(
        "lineitem", {"revenue": Metric("sum", "l_extendedprice"), "lines": Metric("count")}, {"nation": ("nation", "n_name"), "status": ("orders", "o_orderstatus")},
        [L.Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"), L.Relationship("orders", "o_custkey", "customer", "c_custkey"), L.Relationship("nation", "n_nationkey", "customer", "c_nationkey")],
    )
    out = L.metric_query(view, {"lineitem": lineitem, "orders": orders, "customer": customer, "nation": nation}, ["revenue", "lines"], ["nation", "status"])
    return out.withColumn("revenue", F.round("revenue", 2))


@query("lineitem", "orders", "customer", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_mktsegment AS segment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def lookup_chain(lineitem, orders, customer):
    one = L.lookup(lineitem, orders, "l_orderkey", "o_orderkey", ["o_custkey"], order_by=["o_orderkey"])
    return L.lookup(one, customer, "o_custkey", "c_custkey", ["c_mktsegment"], aliases={"c_mktsegment": "segment"}, order_by=["c_custkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "segment")


@query("orders", "customer", sql="""
WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS nl FROM orders GROUP BY 1), r AS (SELECT CAST(c_custkey AS VARCHAR) AS k, count(*) AS nr FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1)
SELECT count(*) AS left_keys, count(nr) AS matched_keys, round(count(nr) / count(*), 4) AS match_rate, count(*) - count(nr) AS unmatched_keys, 'N:1' AS cardinality,
 sum(nl * greatest(coalesce(nr, 0), 1))::BIGINT AS output_rows, (sum(nl * greatest(coalesce(nr, 0), 1)) - sum(nl))::BIGINT AS growth, max(nr) AS most_matches FROM l LEFT JOIN r USING (k)""")
def relationships(orders, customer):
    return P.relationship(orders, "o_custkey", customer.where("c_custkey % 3 > 0"), "c_custkey").select("left_keys", "matched_keys", "match_rate", "unmatched_keys", "cardinality", "output_rows", "growth", "most_matches")


@query("customer", "orders", sql="""
WITH l AS (SELECT c_custkey AS k FROM customer), r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT sum(greatest(coalesce(n, 0), 1))::BIGINT AS output_rows, (sum(greatest(coalesce(n, 0), 1)) - count(*))::BIGINT AS growth, max(n) AS most_matches FROM l LEFT JOIN r USING (k)""")
def join_expansion(customer, orders):
    return P.relationship(customer, "c_custkey", orders, "o_custkey").select("output_rows", "growth", "most_matches")


@query("orders", "customer", sql="SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def unmatched_keys(orders, customer):
    from ..operators.reshape import unmatched_keys as unmatched

    return unmatched(orders, customer.where("c_custkey % 3 > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
