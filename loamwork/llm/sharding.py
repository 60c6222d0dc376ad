"""Operator 9: shards of near equal bytes by sampled splitters.

Law ``bytes``. The key of a document is (hash of its text, crc32, doc_id), so equal texts lie side by side. A
size-weighted sample of keys gives quantile boundaries; rows are range-partitioned by them, and a range that came out
larger than planned is divided further by the running size inside it. A document's place on the line of all bytes, which
is known exactly from the sums of the ranges before it, then decides its shard. So shard sizes differ by about the size
of one document. A group of equal texts stays in one shard unless it is over ``whole`` of a shard's size; larger groups
are spread over neighbouring shards, whatever share of the rows they hold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, materialize, shuffle_partitions

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, sample_keys: int = 20_000, whole: float = 0.02, max_range_rows: int = 1_000_000, overfull: float = 2.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Null texts have no bytes (size ``OVERHEAD``, crc32 0). Repeated rows count each. An empty table gives no rows.
    ``sample_keys`` bounds the sampled keys in expectation; they and two numbers a range are all that the driver sees.
    A range with over ``overfull`` times its planned bytes, or over ``max_range_rows`` rows, is divided by a sample of its
    own, up to 20 times. A row's key ends with a hash of its place in the scan, so even equal rows can be divided. At
    last a cut inside a group that is to stay whole moves to the group's start.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = id_and_text(docs).select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    tie = F.shiftleft(F.col("text_crc32"), 31) + F.pmod(F.xxhash64("h", "text_crc32", "doc_id", F.monotonically_increasing_id()), F.lit(1 << 31))
    keyed = materialize(keyed.withColumn("tie", tie), "shard-keys")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not rows:
        return keyed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    spark = docs.sparkSession
    ranges = max(4 * shards, 2 * shuffle_partitions(spark), rows // max_range_rows)
    # a row is in the sample with a chance of its size / (total / sample_keys), by a hash of its key and not by place
    drawn = keyed.where((F.pmod(F.xxhash64("tie", "doc_id"), F.lit(1 << 30)) / float(1 << 30)) * total <= F.col("size") * float(max(sample_keys, 8 * ranges)))
    sample = sorted((r["h"], r["tie"]) for r in drawn.select("h", "tie").collect())
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    cuts = _rounded(keyed, _divided(keyed, cuts, overfull * total / ranges, max_range_rows), whole * total / shards)
    at = keyed.withColumn("range", _range_of(cuts)("h", "tie"))
    placed = _on_the_line(at, total, shards, whole)
    return _slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _divided(keyed: DataFrame, cuts: list[tuple[int, int]], most_bytes: float, most_rows: int, keys: int = 64, rounds: int = 20) -> list[tuple[int, int]]:
    """``cuts`` and, inside every range that is over a limit and holds more than one row, the quantiles of some ``keys`` drawn there.

    A round needs sums by range (a row each) and some ``keys`` for every overfull range; a range of one row stays.
    """
    for _ in range(rounds):
        at = keyed.withColumn("range", _range_of(cuts)("h", "tie"))
        sums = at.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        over = {r["range"]: (r["rows"], max(2, math.ceil(max(r["bytes"] / most_bytes, r["rows"] / most_rows)))) for r in sums if r["rows"] > 1 and (r["bytes"] > most_bytes or r["rows"] > most_rows)}
        if not over:
            break
        parts = keyed.sparkSession.createDataFrame([(k, min(1.0, keys * max(1, w / 8) / n)) for k, (n, w) in over.items()], "range int, chance double")
        luck = F.pmod(F.xxhash64("tie", "h"), F.lit(1 << 30)) / float(1 << 30)
        found: dict[int, list] = {}
        for r in at.join(F.broadcast(parts), "range").where(luck <= F.col("chance")).select("range", "h", "tie").collect():
            found.setdefault(r["range"], []).append((r["h"], r["tie"]))
        new = {sorted(x)[len(x) * i // over[k][1]] for k, x in found.items() for i in range(1, over[k][1])} - set(cuts)
        if not new:
            break
        cuts = sorted({*cuts, *new})
    return cuts


def _rounded(keyed: DataFrame, cuts: list[tuple[int, int]], most: float) -> list[tuple[int, int]]:
    """Cuts inside a group of equal texts of up to ``most`` bytes moved to its start. The upper bits of a tie are the crc32."""
    groups = sorted({(h, tie >> 31) for h, tie in cuts})
    if not groups:
        return cuts
    asked = F.broadcast(keyed.sparkSession.createDataFrame(groups, "h long, text_crc32 long"))
    sums = keyed.join(asked, ["h", "text_crc32"]).groupBy("h", "text_crc32").agg(F.sum("size").alias("size")).collect()  # a row a cut at most
    whole = {(r["h"], r["text_crc32"]) for r in sums if r["size"] <= most}
    return sorted({(h, tie >> 31 << 31) if (h, tie >> 31) in whole else (h, tie) for h, tie in cuts})


def _range_of(cuts: list[tuple[int, int]]):
    """How many of the sorted cuts are at or below (h, tie), by binary search."""
    h_cuts, tie_cuts = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def find(h: pd.Series, tie: pd.Series) -> pd.Series:
        left, right = np.searchsorted(h_cuts, h, "left"), np.searchsorted(h_cuts, h, "right")
        out = left.copy()
        shared = np.flatnonzero(right > left)
        for a, b in {*zip(left[shared].tolist(), right[shared].tolist())}:
            rows = shared[left[shared] == a]
            out[rows] = a + np.searchsorted(tie_cuts[a:b], tie.to_numpy()[rows], "right")
        return pd.Series(out.astype(np.int32))

    return find


def _offsets(sums: DataFrame, key: str, value: str) -> DataFrame:
    """A small table (key, before): the sum of ``value`` over smaller keys. One row a range, so its size is bounded."""
    before, out = 0, []
    for r in sums.orderBy(key).collect():
        out.append((r[key], before))
        before += r[value]
    return F.broadcast(sums.sparkSession.createDataFrame(out, f"{key} int, before long"))


def _on_the_line(at: DataFrame, total: int, shards: int, whole: float) -> DataFrame:
    """Adds shard: where the middle of the row (or of its group, if that is kept whole) lies on the line of all bytes."""
    order = Window.partitionBy("range").orderBy("h", "tie", F.col("doc_id").asc_nulls_first(), "size")
    group = Window.partitionBy("range", "h", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = at.withColumn("upto", F.sum("size").over(upto)).withColumn("group_size", F.sum("size").over(group)).withColumn("group_end", F.max("upto").over(group))
    sums = at.groupBy("range").agg(F.sum("size").alias("n"))
    line = inside.join(_offsets(sums, "range", "n"), "range")
    kept = F.col("group_size") <= whole * total / shards
    middle = F.col("before") + F.when(kept, F.col("group_end") - F.col("group_size") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    return line.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"))


def _slots(placed: DataFrame) -> DataFrame:
    """Adds slot: gapless in each shard, from counts by (shard, range) and a running number inside each."""
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("range", "shard").orderBy("h", "tie", F.col("doc_id").asc_nulls_first(), "size")
    numbered = placed.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(first.select("shard", "range", "first")), ["shard", "range"]).withColumn("slot", F.col("first") + F.col("number"))
