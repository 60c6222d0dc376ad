"""Running values over (partition, order) with no partition in one task: range partitions, and what each carries to the next.

Rows are range-partitioned and sorted by (keys, order) and written, as their places must be the same in all passes. The last
keys of each range, and the running value there, are collected (a row a range); a range whose first keys are the last ones
of the range before starts from what is carried over.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tail: Column, kind: str, combine: Callable, at_row: Callable[[Window], Column], output: str) -> DataFrame:
    """``tail``: aggregate over a range's rows of its last keys; ``combine(carried, tail)`` gives what is carried on."""
    by = [*[F.col(f"`{k}`") for k in keys], *order]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "segments")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    key = F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keys])
    ends = placed.groupBy("_part").agg(F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"))
    tails = placed.join(F.broadcast(ends), "_part").where(key.eqNullSafe(F.col("_last"))).groupBy("_part").agg(F.first("_first").eqNullSafe(F.first("_last")).alias("alone"), F.first("_first").alias("first"), F.first("_last").alias("last"), tail.alias("tail"))
    carried, last, rows = None, None, []
    for r in tails.orderBy("_part").collect():
        carried = carried if last is not None and repr(r["first"]) == last else None
        rows.append((r["_part"], carried))
        carried, last = combine(carried if r["alone"] else None, r["tail"]), repr(r["last"])
    known = df.sparkSession.createDataFrame(rows or [(0, None)], f"_part long, _carried {kind}")
    joined = placed.join(F.broadcast(ends.join(F.broadcast(known), "_part")), "_part")
    carry = F.when(key.eqNullSafe(F.col("_first")), F.col("_carried"))
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("_carry", carry).withColumn(output, at_row(inside)).drop("_at", "_part", "_first", "_last", "_carried", "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, output: str) -> DataFrame:
    """Adds the sum of ``value`` (a whole number, not null) over the rows of the same keys up to this one."""
    total = lambda w: F.sum(value).over(w) + F.coalesce("_carry", F.lit(0).cast("long"))
    return _running(df, keys, order, F.sum(value), "long", lambda a, b: (a or 0) + b, total, output)


def last_value(df: DataFrame, keys: Sequence[str], order: Sequence[Column], source: str, output: str) -> DataFrame:
    """Adds the last value of ``source`` that isn't null, up to this row, among the rows of the same keys."""
    c = F.col(f"`{source}`")
    kind = df.select(c.alias("v")).schema[0].dataType.simpleString()
    tail = F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), F.col("_at")))
    value = lambda w: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col("_carry"))
    return _running(df, keys, order, tail, kind, lambda a, b: b["v"] if b is not None and b["v"] is not None else a, value, output)


def group_quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], p: float) -> DataFrame:
    """keys and, for each name, the exact ``p`` quantile (linear between neighbours) of a numeric value by group.

    Equal values of a group are counted first, with partial sums; counts then run over ranges of (name, keys, value), so a
    group of any size is spread over tasks. Null values are left out; a group without any has null.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    group = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    cells = F.array(*[F.struct(F.lit(i).alias("_name"), x.cast("double").alias("_x")) for i, x in enumerate(values.values())])
    counts = df.select(*group, F.inline(cells)).where("_x is not null").groupBy("_name", *names, "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sum(counts, ["_name", *names], [F.col("_x")], F.col("_c"), "_upto")
    totals = counts.groupBy("_name", *names).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for n in ["_name", *names]:
        same = same & upto[n].eqNullSafe(totals[n])
    place = (F.col("_n") - 1) * F.lit(p)
    low, first = F.floor(place), F.col("_upto") - F.col("_c")
    holds = lambda i: F.max(F.when((first <= i) & (i < F.col("_upto")), F.col("_x")))
    near = upto.join(totals, same).where((first <= low + 1) & (low < F.col("_upto"))).select(*[upto[c] for c in ["_name", *names, "_x", "_c", "_upto"]], "_n")
    found = near.groupBy("_name", *names).agg(holds(low).alias("_a"), holds(F.ceil(place)).alias("_b"), F.max(place - low).alias("_share"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")
    wide = found.groupBy(*names).agg(*[F.max(F.when(F.col("_name") == i, value)).alias(v) for i, v in enumerate(values)])
    every = df.select(*group).distinct() if names else None
    if every is None:
        return wide
    same = F.lit(True)
    for n in names:
        same = same & every[n].eqNullSafe(wide[n])
    return every.join(wide, same, "left").select(*[every[n].alias(k) for n, k in zip(names, keys)], *values)


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float], accuracy: int = 10_000, most: int = 50_000) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between neighbours) of many numeric columns at once, by ranges that narrow.

    A sketch of fixed size brackets each quantile; the values below and inside each bracket are counted, and brackets with
    over ``most`` values are sketched again inside, all columns in one pass; then the distinct values inside are fetched.
    The sketch's rank error is 1 / ``accuracy`` at most, so a pass narrows a bracket some thousandfold, and no task or
    driver holds more than the sketches and ``most`` values a bracket. Least and greatest values (0 and 1) need no bracket.
    """
    names = [f"_v{i}" for i in range(len(values))]
    data = df.select(*[x.cast("double").alias(n) for n, x in zip(names, values.values())])
    if not names:
        return {}
    inner = [p for p in probabilities if 0 < p < 1]
    slots = [(n, p) for n in names for p in inner]
    spread = 2.0 / accuracy
    clip = lambda x: min(1.0, max(0.0, x))
    first = data.agg(*[F.count(n).alias(f"{n}_n") for n in names], *[F.min(n).alias(f"{n}_lo") for n in names], *[F.max(n).alias(f"{n}_hi") for n in names], *[F.percentile_approx(n, [clip(p - spread), clip(p + spread)], accuracy).alias(f"{n}_{j}") for n in names for j, p in enumerate(inner)]).first()
    held = {n: first[f"{n}_n"] for n in names}
    bracket = {}
    for n in names:
        for j, p in enumerate(inner):
            lo, hi = first[f"{n}_{j}"] or (None, None)
            few = held[n] <= max(most, accuracy)  # the ranks of a sketch are too coarse for so few
            bracket[n, p] = (first[f"{n}_lo"] if few or p <= spread else lo, first[f"{n}_hi"] if few or p >= 1 - spread else hi)
    live = [s for s in slots if held[s[0]]]
    rank = {(n, p): int((held[n] - 1) * p) for n, p in live}
    after = {}
    while True:
        sums = data.agg(F.count(F.lit(1)), *[F.count(F.when(test, 1)).alias(f"{name}{i}") for i, (n, p) in enumerate(live) for lo, hi in [bracket[n, p]] for name, test in (("below", F.col(n) < lo), ("inside", F.col(n).between(lo, hi)))]).first()
        wide = [(i, s) for i, s in enumerate(live) if sums[f"inside{i}"] > most and bracket[s][0] < bracket[s][1] and bracket[s] != after.get(s)]
        if not wide:
            break
        asked = []
        for i, s in wide:
            at = (rank[s] - sums[f"below{i}"]) / sums[f"inside{i}"]
            inside = F.when(F.col(s[0]).between(*bracket[s]), F.col(s[0]))
            slack = spread + 1.5 / sums[f"inside{i}"]  # a sketch takes the nearest rank
            asked.append(F.percentile_approx(inside, [clip(at - slack), clip(at + slack)], accuracy).alias(f"s{i}"))
        found = data.agg(*asked).first()
        for i, s in wide:
            after[s] = bracket[s]
            bracket[s] = tuple(found[f"s{i}"])
    fetch = [F.when(F.col(n).between(*bracket[n, p]), F.struct(F.lit(i).alias("slot"), F.col(n).alias("x"))) for i, (n, p) in enumerate(live)]
    inside: dict[int, list[tuple[float, int]]] = {}
    if live:
        for r in data.select(F.inline(F.array_compact(F.array(*fetch)))).groupBy("slot", "x").count().collect():
            inside.setdefault(r["slot"], []).append((r["x"], r["count"]))
    # the value after the last one of a bracket, where the upper neighbour lies outside
    above = data.agg(F.count(F.lit(1)), *[F.min(F.when(F.col(n) > bracket[n, p][1], F.col(n))).alias(f"a{i}") for i, (n, p) in enumerate(live)]).first()
    out: dict[str, list[float | None]] = {v: [] for v in values}
    for v, n in zip(values, names):
        for p in probabilities:
            if not held[n]:
                out[v].append(None)
                continue
            if p not in inner:
                out[v].append(first[f"{n}_lo" if p <= 0 else f"{n}_hi"])
                continue
            i = live.index((n, p))
            place = (held[n] - 1) * p
            upto, a, b = sums[f"below{i}"], None, None
            for x, c in sorted(inside.get(i, [])):
                a = x if upto <= int(place) < upto + c else a
                b = x if upto <= int(place) + 1 < upto + c else b
                upto += c
            b = above[f"a{i}"] if b is None else b
            out[v].append(a if b is None or place == int(place) else a + (b - a) * (place - int(place)))
    return out


def exact_sum(x: Column, most: float | None) -> Column:
    """Aggregate: the sum of doubles, the same in whatever order rows come; ``most`` is the greatest absolute value.

    A double is a whole number of steps, of which ``most`` has 2**61 at least, and of parts, 2**60 a step; both are added as
    decimals. What is less than a part is cut, at most 2**-121 of ``most`` a row. A sum that isn't finite is left to ``sum``.
    """
    places = min(62 - math.frexp(most or 0.0)[1], 1000)
    scaled = x * F.lit(2.0**places)
    added = lambda c: F.sum(F.floor(c).cast("decimal(20,0)"))
    parts = added((scaled - F.floor(scaled)) * 2.0**60)
    rest = parts % F.lit(1 << 60)
    steps = added(scaled) + F.floor((parts - rest).cast("double") * 2.0**-60).cast("decimal(20,0)")
    plain = F.sum(x)
    return F.when(F.abs(plain) < math.inf, (steps.cast("double") + rest.cast("double") * 2.0**-60) * F.lit(2.0**-places)).otherwise(plain)
