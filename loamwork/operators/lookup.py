"""Lookups that never multiply rows, roll-ups of details onto masters, and metric views over declared relationships."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key, strip, text, to_number
from ..sources.scratch import written
from .rows import order_of
from .summarize import Metric, metric_column

MODES = ("exact", "trim", "case_insensitive", "normalized_exact", "fuzzy")
POLICIES = ("first", "error", "list", "aggregate", "review")


class DuplicateKeys(ValueError):
    """The right side of a lookup repeats keys and the policy is ``error``."""


def match_key(c: Column, mode: str) -> Column:
    """The key as compared; blank keys are null and match nothing."""
    s = c.cast("string")
    made = {"exact": s, "trim": strip(s), "case_insensitive": F.lower(s), "normalized_exact": normalize_key(s), "fuzzy": normalize_key(s)}[mode]
    return F.when(strip(made) != "", made)


def _keys(columns: Sequence[str], mode: str) -> Column:
    parts = [match_key(F.col(f"`{c}`"), mode) for c in columns]
    whole = F.concat_ws("\x1f", *parts)
    blank = parts[0].isNull()
    for p in parts[1:]:
        blank = blank | p.isNull()
    return F.when(~blank, whole)


def _apart(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """``df`` with white space in place of each null of the column ``key``, as the columns ``by`` and the partition have it.

    Nulls meet nothing, but a join on them brings them all to one task. White space meets nothing either, as no key is
    blank, and goes to all tasks; a retried task makes the same.
    """
    digits = F.lpad(F.bin(F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in by]), F.lit(1 << 16))), 16, "0")
    return df.withColumn(key, F.coalesce(key, F.translate(digits, "01", " \t")))


def _prepared(right: DataFrame, keys: Sequence[str], fields: Sequence[str], mode: str, policy: str, order_by, sep: str) -> DataFrame:
    """One row for each key: (_key, _n, fields...)."""
    keyed = right.select(_keys(keys, mode).alias("_key"), *[F.col(f"`{f}`").alias(f"_f{i}") for i, f in enumerate(fields)], F.struct(*order_of(right, order_by)).alias("_order")).where("_key is not null")
    if policy == "error":
        twice = keyed.groupBy("_key").count().where("count > 1").orderBy("_key").limit(10).collect()
        if twice:
            raise DuplicateKeys(f"repeated keys: {[r['_key'].replace(chr(31), ' / ') for r in twice]}")
    n = F.count(F.lit(1)).alias("_n")
    if policy in ("first", "review", "error"):
        taken = F.min_by(F.struct(*[F.col(f"_f{i}") for i in range(len(fields))], F.lit(1).alias("_one")), "_order").alias("_hit")
        return keyed.groupBy("_key").agg(n, taken).select("_key", "_n", *[F.col(f"_hit._f{i}").alias(f"_f{i}") for i in range(len(fields))])

    summed = set()
    if policy == "aggregate":
        kinds = right.select(*fields).agg(*[(F.count(f"`{f}`") - F.count(to_number(F.col(f"`{f}`")))).alias(f"_c{i}") for i, f in enumerate(fields)]).first()
        summed = {i for i in range(len(fields)) if kinds[i] == 0}
    sums = keyed.groupBy("_key").agg(n, *[F.sum(to_number(F.col(f"_f{i}"))).alias(f"_f{i}") for i in sorted(summed)])
    texts = [i for i in range(len(fields)) if i not in summed]
    if not texts:
        return sums
    # what is distinct first, with partial sums, so that no list is longer than a key has different values
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), strip(text(F.col(f"_f{i}"))).alias("_v")) for i in texts])
    distinct = keyed.select("_key", "_order", F.inline(cells)).where("_v <> ''").groupBy("_key", "_i", "_v").agg(F.min("_order").alias("_order"))
    ordered = lambda i: F.array_sort(F.collect_list(F.when(F.col("_i") == i, F.struct("_order", "_v"))))
    lists = distinct.groupBy("_key").agg(*[F.array_join(F.transform(ordered(i), lambda x: x["_v"]), sep).alias(f"_f{i}") for i in texts])
    return sums.join(lists, "_key", "left").select("_key", "_n", *[(F.col(f"_f{i}") if i in summed else F.coalesce(F.col(f"_f{i}"), F.lit(""))).alias(f"_f{i}") for i in range(len(fields))])


def lookup(
    left: DataFrame, right: DataFrame, left_key: str | Sequence[str], right_key: str | Sequence[str], fields: Sequence[str], *,
    aliases: Mapping[str, str] | None = None, suffix: str = "_lookup", mode: str = "exact", policy: str = "first", order_by: Sequence | None = None,
    sep: str = "; ", match_field: str | None = None, confidence_field: str | None = None, explanation_field: str | None = None,
    ambiguity_field: str | None = None, threshold: float = 0.85,
) -> DataFrame:
    """Left join on keys that keeps every left row once, whatever the right side repeats.

    ``policy`` for repeated right keys: ``first`` by ``order_by``, ``error``, ``list`` (distinct values in order),
    ``aggregate`` (sum where all values of the field are numbers, else list; decided per field, so types are static) or
    ``review`` (first, flagged, confidence at most 0.65). Field names that are taken get ``suffix``.
    """
    if mode not in MODES or policy not in POLICIES:
        raise ValueError(f"mode is one of {MODES}, policy one of {POLICIES}")
    lk = [left_key] if isinstance(left_key, str) else list(left_key)
    rk = [right_key] if isinstance(right_key, str) else list(right_key)
    if len(lk) != len(rk):
        raise ValueError("keys differ in length")
    if clash := {"_key", "_n", "_left_key", "right_key", "score", *(f"_f{i}" for i in range(len(fields)))} & set(left.columns):
        hidden = {c: f"_own{i}_{c}" for i, c in enumerate(sorted(clash))}
        found = lookup(
            left.withColumnsRenamed(hidden), right, [hidden.get(k, k) for k in lk], rk, fields, aliases={f: f"_got{i}" for i, f in enumerate(fields)}, suffix=suffix, mode=mode, policy=policy, order_by=order_by, sep=sep,
            match_field=match_field, confidence_field=confidence_field, explanation_field=explanation_field, ambiguity_field=ambiguity_field, threshold=threshold,
        )
        taken, names = set(left.columns), {v: k for k, v in hidden.items()}
        for i, f in enumerate(fields):
            name = (aliases or {}).get(f, f)
            names[f"_got{i}"] = name = name + suffix if name in taken else name
            taken.add(name)
        return found.withColumnsRenamed(names)
    table = _prepared(right, rk, fields, mode, policy, order_by, sep)
    keyed = left.withColumn("_key", _keys(lk, mode))
    if mode == "fuzzy":
        best = fuzzy_matches(keyed.select("_key"), table.select("_key"), threshold)
        keyed = _apart(keyed, "_key", lk).join(best.withColumnRenamed("left_key", "_key"), "_key", "left")
        keyed = _apart(keyed.withColumnRenamed("_key", "_left_key"), "right_key", ["_left_key"])
        joined = keyed.join(table.withColumnRenamed("_key", "right_key"), "right_key", "left").withColumnRenamed("_left_key", "_key")
        confidence = F.coalesce(F.col("score"), F.lit(0.0))
    else:
        joined = _apart(keyed, "_key", lk).join(table, "_key", "left")
        confidence = F.when(F.col("_n").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    matched, many = F.col("_n").isNotNull(), F.coalesce(F.col("_n") > 1, F.lit(False))
    if policy == "review":
        confidence = F.when(many, F.least(confidence, F.lit(0.65))).otherwise(confidence)
    taken, out = set(left.columns), [F.col(f"`{c}`") for c in left.columns]
    for i, f in enumerate(fields):
        name = (aliases or {}).get(f, f)
        name = name + suffix if name in taken else name
        taken.add(name)
        out.append(F.col(f"_f{i}").alias(name))
    why = (
        F.when(strip(F.col("_key")) == "", "blank key").when(~matched & F.lit(mode == "fuzzy"), "no candidate reaches the threshold").when(~matched, "no match")
        .when(many & F.lit(policy == "review"), "several matches, first taken for review").when(F.lit(mode == "fuzzy") & (confidence < 1), "similar key").otherwise("matched")
    )
    for name, column in ((match_field, matched), (confidence_field, confidence), (explanation_field, why), (ambiguity_field, many)):
        if name:
            out.append(column.alias(name))
    return joined.select(*out)


#: Longest keys whose neighbours are looked up by what is left of a key when one character is deleted, and when two are.
ONE, NEAR = 256, 24
#: Longer keys with up to ``FAR`` characters left over are looked up by their rarest stretches of ``STRETCH`` characters.
FAR, STRETCH = 3, 6
#: Groups of characters that are counted for each key.
COUNTS = 16


def fuzzy_matches(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key, score): for each distinct left key the best right key by matching-blocks ratio.

    Equal keys match at 1; ties go to the smaller right key. Matching blocks of m characters in all are a common
    subsequence, so two keys of together s characters score (s - u) / s at most, if u of them are in no such subsequence.
    Steps of rising u meet all pairs up to it: keys with one character deleted, short keys with two, long keys by
    stretches of characters. A left key is done after a step if no pair with a larger u can reach its best score, or the
    threshold. What is left asks an inverted index (``index_pairs``). Candidates are scored in Arrow batches. Joins are
    sorted ones, as the size of a compressed file says little of the rows made from it.
    """
    l, r = left.where("_key is not null").distinct(), written(right.where("_key is not null").distinct(), "fuzzy-right").hint("merge")
    same = l.join(r, "_key").select(F.col("_key").alias("left_key"), F.col("_key").alias("right_key"), F.lit(1.0).alias("score"))
    rest, n, found = written(l.join(r, "_key", "left_anti"), "fuzzy-left"), F.length("_key"), []
    steps = (
        (1, n + 1 <= ONE, lambda x: near_pairs(x, r, 1)),
        (2, n + 2 <= NEAR, lambda x: near_pairs(x, r, 2)),
        (FAR, n - FAR >= STRETCH * (FAR + 1), lambda x: stretch_pairs(x, r)),
    )
    for most, whole, pairs in steps:
        asking = rest.where(whole)
        if asking.isEmpty():
            continue
        best = written(_best(pairs(asking), threshold), "fuzzy-best")
        found.append(best)
        beyond = 2 * n / (2 * n + most + 1) + 1e-9
        known = rest.join(best.select(F.col("left_key").alias("_key"), "score").hint("merge"), "_key", "left")
        rest = written(known.where(~(whole & (F.coalesce("score", F.lit(threshold)) > beyond))).select("_key"), "fuzzy-left")
    if not rest.isEmpty():
        found.append(_best(index_pairs(rest, r, threshold), threshold))
    return same.union(_best_of(reduce(DataFrame.union, found))) if found else same


def _best_of(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("left_key").agg(F.min_by(F.struct("right_key", "score"), F.struct(-F.col("score"), "right_key")).alias("b"))
    return best.select("left_key", "b.right_key", "b.score")


def _best(pairs: DataFrame, threshold: float) -> DataFrame:
    scored = pairs.select("left_key", "right_key", _ratio(threshold)(F.col("left_key"), F.col("right_key")).alias("score"))
    return _best_of(scored.where(F.col("score") >= threshold))


def near_pairs(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(left_key, right_key): pairs of keys that share a subsequence with up to ``most`` (1 or 2) characters left over.

    Keys of up to ``ONE`` characters for one, of up to ``NEAR`` for two.
    """
    key, n = F.col("_key"), F.length("_key")
    cut = lambda i: F.concat(F.substr(key, F.lit(1), i - 1), F.substr(key, i + 1))
    cut_two = lambda i, j: F.concat(F.substr(key, F.lit(1), i - 1), F.substr(key, i + 1, j - i - 1), F.substr(key, j + 1))
    ones = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), cut)).otherwise(F.array())
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: cut_two(i, j)))
    twos = F.when(n >= 2, F.flatten(pairs)).otherwise(F.array())

    def left_over(df: DataFrame, name: str, uses: Sequence[tuple[int, Sequence[int]]]) -> DataFrame:
        """Rows (name, h, i): a hash of what is left, for each number i of characters that the left key may lose."""
        made = {0: F.array(key), 1: ones, 2: twos}
        every = F.concat(*[F.transform(F.array_distinct(made[lost]), lambda x: F.struct(F.xxhash64(x).alias("h"), F.lit(i).alias("i"))) for lost, numbers in uses for i in numbers])
        return df.where(n <= (ONE if most == 1 else NEAR)).select(key.alias(name), F.inline(every))

    a = left_over(left, "left_key", [(i, [i]) for i in range(most + 1)])
    b = left_over(right, "right_key", [(lost, range(most + 1 - lost)) for lost in range(most + 1)])
    return a.join(b.hint("merge"), ["h", "i"]).select("left_key", "right_key").distinct()


def stretch_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key): pairs with up to ``FAR`` characters left over, of right keys with ``FAR`` + 1 stretches or more.

    A right key is cut into stretches of ``STRETCH`` characters. A character left over spoils one of them at most, so of
    any ``FAR`` + 1 one stands in the left key whole, up to ``FAR`` places away: the rarest are asked for. Counts of
    ``COUNTS`` groups of characters bound what two keys can have in common.
    """
    key, n = F.col("_key"), F.length("_key")
    stretch = lambda at: F.struct(F.substr(key, at, F.lit(STRETCH)).alias("s"), at.alias("at"))
    groups = F.transform(F.filter(F.split(key, ""), lambda x: x != ""), lambda x: (F.crc32(x.cast("binary")) % COUNTS).cast("int"))
    counted = F.transform(F.sequence(F.lit(0), F.lit(COUNTS - 1)), lambda g: F.size(F.filter("groups", lambda x: x == g)))

    def cut(df: DataFrame, name: str, least: int, step: int) -> DataFrame:
        long = df.where(n >= least).select("_key", groups.alias("groups"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - STRETCH + 1), F.lit(step))  # shorter keys may be asked before they are left out
        return long.select(key.alias(name), n.alias(f"{name}_n"), counted.alias(f"{name}_counts"), F.transform(starts, stretch).alias("cut"))

    b = cut(right, "right_key", STRETCH * (FAR + 1), STRETCH)
    each = b.select("right_key", F.inline("cut"))
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(shared.hint("merge"), "s", "left").groupBy("right_key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "at", "s"))).alias("cut"))
    asked = ranked.select("right_key", F.inline(F.slice("cut", 1, FAR + 1))).select("right_key", "s", F.col("at").alias("right_at"))
    asked = asked.join(b.drop("cut").hint("merge"), "right_key")
    a = cut(left, "left_key", STRETCH * (FAR + 1) - FAR, 1).select("left_key", "left_key_n", "left_key_counts", F.inline("cut"))
    common = reduce(lambda x, y: x + y, [F.least(F.col("left_key_counts")[i], F.col("right_key_counts")[i]) for i in range(COUNTS)])
    fits = (F.abs(F.col("at") - F.col("right_at")) <= FAR) & (F.col("left_key_n") + F.col("right_key_n") - 2 * common <= FAR)
    return a.join(asked.hint("merge"), "s").where(fits).select("left_key", "right_key").distinct()


def index_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key) that may score ``threshold``, by an inverted index of characters, with their repeats, in order of frequency.

    Keys of n characters need a partner with at least t * n / (2 - t) of them in common, so they meet through one of the
    rarest n + 1 - t * n / (2 - t), in neighbouring bands of length. Inside the join, counts of ``COUNTS`` groups of
    characters bound what two keys can have in common.
    """
    t = threshold
    need = lambda n: F.ceil(t / (2 - t) * n - 1e-9)
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(math.log((2 - t) / t) if t < 1 else 1.0)) if t < 1 else F.col("n")

    def characters(df: DataFrame) -> DataFrame:
        chars = F.filter(F.split("_key", ""), lambda x: x != "")
        each = df.select("_key", F.explode(chars).alias("c")).groupBy("_key", "c").agg(F.count(F.lit(1)).cast("int").alias("k"))
        return each.select("_key", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k"), "c")

    frequent = characters(right).groupBy("c", "k").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "c", "k").limit(2000)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        """Each key with its counts and rarest characters (those that aren't among the frequent ones come first)."""
        tokens = characters(df).join(F.broadcast(frequent), ["c", "k"], "left").withColumn("g", F.crc32(F.col("c").cast("binary")) % COUNTS)
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "c", "k")))
        counts = [F.count(F.when(F.col("g") == i, 1)).cast("int").alias(f"{name}_{i}") for i in range(COUNTS)]
        made = tokens.groupBy("_key").agg(F.count(F.lit(1)).cast("int").alias("n"), ordered.alias("tokens"), *counts)
        first = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), (F.col("n") - need(F.col("n")) + 1).cast("int")))
        return made.select(F.col("_key").alias(name), F.col("n").alias(f"{name}_n"), band.cast("int").alias("band"), *[f"{name}_{i}" for i in range(COUNTS)], F.explode(first).alias("t")).select("*", F.col("t.c").alias("c"), F.col("t.k").alias("k")).drop("t")

    a, b = keyed(left, "left_key"), keyed(right, "right_key")
    a = a.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)]))) if t < 1 else a
    common = reduce(lambda x, y: x + y, [F.least(f"left_key_{i}", f"right_key_{i}") for i in range(COUNTS)])
    fits = 2.0 * common >= t * (F.col("left_key_n") + F.col("right_key_n")) - 1e-9
    return a.join(b, ["c", "k", "band"]).where(fits).select("left_key", "right_key").distinct()


def _ratio(threshold: float):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(x: str, y: str) -> float:
            m = SequenceMatcher(None, x, y)
            return m.ratio() if m.quick_ratio() >= threshold else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def rollup(master: DataFrame, detail: DataFrame, left_key: str, right_key: str, metric: Metric, fill=0, order_by: Sequence[str] | None = None) -> DataFrame:
    """Aggregate the details of each key onto the master; without details the value is ``fill``. Row count unchanged."""
    sums = detail.groupBy(F.col(f"`{right_key}`").alias("_key")).agg(metric_column(metric, detail, order_by).alias("_value"))
    joined = master.join(sums, master[left_key] == sums["_key"], "left")
    value = F.coalesce(F.col("_value"), F.lit(fill)) if fill is not None else F.col("_value")
    return joined.select(*[master[c] for c in master.columns], value.alias(metric.name))


@dataclass(frozen=True)
class Relationship:
    left: str
    left_key: str
    right: str
    right_key: str


@dataclass(frozen=True)
class MetricView:
    """Named measures and dimensions over one fact table and the tables it refers to."""

    fact: str
    measures: Mapping[str, Metric]
    dimensions: Mapping[str, tuple[str, str]]  # name -> (table, column)
    relationships: Sequence[Relationship] = field(default_factory=tuple)


def metric_query(view: MetricView, tables: Mapping[str, DataFrame], measures: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Group the fact table by dimensions. Tables on the way are looked up by declared keys, which must not repeat."""
    unknown = [m for m in measures if m not in view.measures] + [d for d in dimensions if d not in view.dimensions]
    if unknown:
        raise ValueError(f"not in the view: {unknown}")
    out, reached = tables[view.fact], {view.fact: {c: c for c in tables[view.fact].columns}}
    wanted = {t: {c for d in dimensions if view.dimensions[d][0] == t for c in [view.dimensions[d][1]]} for t in {view.dimensions[d][0] for d in dimensions}}
    path = _path(view, set(wanted))
    for r in path:
        needed = wanted.get(r.right, set()) | {x.left_key for x in path if x.left == r.right}
        names = {c: f"{r.right}.{c}" for c in sorted(needed)}
        right = tables[r.right]
        out = lookup(out, right, reached[r.left][r.left_key], r.right_key, sorted(needed), aliases=names, policy="error", order_by=[r.right_key])
        reached[r.right] = names
    keys = [F.col(f"`{reached[view.dimensions[d][0]][view.dimensions[d][1]]}`").alias(d) for d in dimensions]
    metrics = [metric_column(Metric(view.measures[m].op, view.measures[m].column, m), out) for m in measures]
    return out.groupBy(*keys).agg(*metrics)


def _path(view: MetricView, tables: set[str]) -> list[Relationship]:
    """Relationships from the fact table to all ``tables``, nearest first; either direction of a declaration will do."""
    both = [*view.relationships, *(Relationship(r.right, r.right_key, r.left, r.left_key) for r in view.relationships)]
    seen, frontier, by = {view.fact}, [view.fact], {}
    while frontier:
        nearest = frontier.pop(0)
        for r in both:
            if r.left == nearest and r.right not in seen:
                seen.add(r.right)
                by[r.right] = r
                frontier.append(r.right)
    missing = tables - seen
    if missing:
        raise ValueError(f"no relationship leads to {sorted(missing)}")
    out: list[Relationship] = []
    for t in sorted(tables - {view.fact}):
        steps = []
        while t != view.fact:
            steps.append(by[t])
            t = by[t].left
        out += [s for s in reversed(steps) if s not in out]
    return out
