"""Connected components of a graph given as DataFrames of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every row of ``nodes`` (node long); root is the least node of its component.

    Alternates large-star and small-star steps: each hangs neighbours on the least node near, so the number of rounds is
    about the logarithm of the longest path, and no step makes more rows than there are edges. The edges of a round are
    written to the shared folder; only their number and one checksum come to the driver.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "components")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        before, now = now, materialize(_small_star(_large_star(now)), "components")
        discard(before)
    hung = now.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(hung, nodes["node"] == hung["a"], "left").select("node", F.coalesce("root", "node").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    moved = near.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
