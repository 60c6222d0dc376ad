"""Relationships between many tables from one index of their keys, and keys folded as NFKC folds them."""

import random
import unicodedata
from collections import Counter

from loamwork.functions.folding import nfkc
from loamwork.operators import lookup, profile
from pyspark.sql import functions as F


def fold(v):
    return unicodedata.normalize("NFKC", str(v)).strip().lower()


def brute(a, b, samples=10):
    left, right = Counter(fold(v) for v in a if v is not None), Counter(fold(v) for v in b if v is not None)
    left.pop("", None), right.pop("", None)
    out = len(a) - sum(left.values()) + sum(n * max(right[k], 1) for k, n in left.items())
    return {
        "left_keys": len(left), "matched_keys": sum(k in right for k in left), "left_rows": sum(left.values()), "matched_rows": sum(n for k, n in left.items() if k in right),
        "output_rows": out, "growth": out - len(a), "most_matches": max((right[k] for k in left), default=0), "right_repeated_keys": sum(n > 1 for n in right.values()),
        "unmatched_samples": sorted(k for k in left if k not in right)[:samples], "repeated_samples": sorted(k for k, n in right.items() if n > 1)[:samples],
        "cardinality": ("N" if max(left.values(), default=0) > 1 else "1") + ":" + ("N" if max(right.values(), default=0) > 1 else "1"),
    }


def test_relationships_equal_brute_force(spark):
    r = random.Random(3)
    pick = lambda n, most: [r.choice([None, "", " ", f"K{r.randrange(most)}", f"ｋ{r.randrange(most)} "]) for _ in range(n)]
    data = {"a": pick(200, 40), "b": pick(80, 60), "c": pick(30, 300), "d": []}
    names = {"a": "cust_id", "b": "Cust ID", "c": "cust id", "d": "cust_id"}
    tables = {t: spark.createDataFrame([(v, i) for i, v in enumerate(vs)], f"`{names[t]}` string, other_{t} int") for t, vs in data.items()}
    found = {(x["left_table"], x["right_table"]): x.asDict() for x in profile.relationships(tables).collect()}
    assert set(found) == {(x, y) for x in data for y in data if x != y}
    for (x, y), row in found.items():
        want = brute(data[x], data[y])
        assert {k: row[k] for k in want} == want, (x, y)
        assert row["row_match_rate"] == (round(want["matched_rows"] / want["left_rows"], 4) if want["left_rows"] else 0.0)
    one = profile.relationship(tables["a"], "cust_id", tables["b"], "Cust ID", "a", "b").first().asDict()
    assert one == found["a", "b"]


def test_fields_of_several_groups(spark):
    a = spark.createDataFrame([(1, 7, 3), (1, 8, 4)], "x_id int, y_id int, x_code int")
    b = spark.createDataFrame([(1, 8, 5)], "x_id int, y_id int, x_code int")
    got = {(x["left_table"], x["left_field"]): (x["left_keys"], x["matched_keys"], x["output_rows"]) for x in profile.relationships({"a": a, "b": b}).collect()}
    assert got == {("a", "x_id"): (1, 1, 2), ("a", "y_id"): (2, 1, 2), ("a", "x_code"): (2, 0, 2), ("b", "x_id"): (1, 1, 2), ("b", "y_id"): (1, 1, 1), ("b", "x_code"): (1, 0, 1)}
    assert profile.relationships({"a": a, "b": b.select(F.col("x_id").alias("z"))}).count() == 0


def test_scans_grow_with_tables_not_with_pairs(spark, tmp_path):
    def scans(n):
        tables = {}
        for i in range(n):
            path = f"{tmp_path}/{n}-{i}"
            spark.range(20).select((F.col("id") % (i + 5)).alias("cust_id"), F.col("id").alias(f"v{i}")).write.parquet(path)
            tables[f"t{i}"] = spark.read.parquet(path)
        df = profile.relationships(tables)
        assert df.count() == n * (n - 1)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [") + plan.count("parquet")

    two, six = scans(2), scans(6)
    assert six == 3 * two


def test_nfkc_equals_the_standard(spark):
    r = random.Random(5)
    odd = [chr(p) for p in range(0x80, 0x20000) if not 0xD800 <= p < 0xE000 and (unicodedata.combining(chr(p)) or unicodedata.decomposition(chr(p)) or 0x1100 <= p < 0x1200)] + list("abAE ｶﾞﾟ각가")
    texts = ["①", "ﬁ", "ｶﾞ", "Å", "Å", "½", "ệ", "́x", "각", "", None, "plain", "编号Ｃ002"] + ["".join(r.choice(odd) for _ in range(r.randint(1, 7))) for _ in range(6000)] + [c for c in odd if ord(c) % 5 == 0]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfkc(F.col("t")).alias("n"))
    for row in df.collect():
        assert row["n"] == (None if row["t"] is None else unicodedata.normalize("NFKC", row["t"]))


def test_lookup_joins_compatible_forms(spark):
    left = spark.createDataFrame([("①",), ("ﬁn",), ("ｶﾞ",), ("Å",), ("Å",), ("㌔",)], "k string")
    right = spark.createDataFrame([("1", 1), ("FIN", 2), ("ガ", 3), ("å", 4), ("キロ", 5)], "k2 string, v int")
    out = lookup.lookup(left, right, "k", "k2", ["v"], mode="normalized_exact", order_by=["v"])
    assert [x["v"] for x in sorted(out.collect(), key=lambda x: str(x["v"]))] == [1, 2, 3, 4, 4, 5]
