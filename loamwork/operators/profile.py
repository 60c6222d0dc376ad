"""Table profiles, keys, relationships between tables, and what they suggest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import condition, with_repeats
from ..functions.text import is_blank, is_key_name, normalize_key, normalize_name, strip, to_number
from .rules import Rule

PROFILE = "table string, column string, dtype string, rows long, nulls long, null_rate double, empty_strings long, distinct_values long, repeated_rows long, samples array<string>"
RELATION = "left_table string, left_field string, right_table string, right_field string, left_keys long, matched_keys long, match_rate double, unmatched_keys long, left_rows long, matched_rows long, row_match_rate double, left_repeats boolean, right_repeats boolean, right_repeated_keys long, cardinality string, output_rows long, growth long, most_matches long, unmatched_samples array<string>, repeated_samples array<string>, advice string"


def profile(df: DataFrame, table: str = "table", approx: bool = False, repeats: Sequence[str] | None = None, samples: int = 3) -> DataFrame:
    """One row for each column: counts, rates, ``repeated_rows`` (rows whose value occurs again; two nulls count) and samples.

    One scan and one shuffle: all cells are counted by (column, value) with partial sums, and everything follows from those
    counts. Samples are the smallest values. ``repeats`` limits the columns that show repeated_rows. With ``approx`` there
    is one aggregate of sketches and no shuffle of values; repeated_rows is null, and samples are the least and greatest.
    """
    columns = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("column"), F.lit(t).alias("dtype")) for i, (n, t) in enumerate(df.dtypes)])
    listed = df.sparkSession.range(1, numPartitions=1).select(F.inline(columns))
    if approx:
        sums = []
        for i, n in enumerate(df.columns):
            c = F.col(f"`{n}`")
            s = c.cast("string")
            ends = F.array_distinct(F.array_compact(F.array(F.min(s), F.max(s))))
            sums.append(F.struct(F.lit(i).alias("place"), F.count(F.lit(1)).alias("rows"), F.count(F.when(c.isNull(), 1)).alias("nulls"), F.count(F.when(strip(s) == "", 1)).alias("empty_strings"), F.approx_count_distinct(c).alias("distinct_values"), F.lit(None).cast("long").alias("repeated_rows"), ends.alias("samples")))
        counted = df.agg(F.array(*sums).alias("a")).select(F.inline("a"))
    else:
        cells = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"`{n}`").cast("string").alias("v")) for i, n in enumerate(df.columns)])
        values = df.select(F.inline(cells)).groupBy("place", "v").agg(F.count(F.lit(1)).alias("n"))
        sum_of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
        counted = values.groupBy("place").agg(
            F.sum("n").alias("rows"), sum_of(F.col("v").isNull()).alias("nulls"), sum_of(strip(F.col("v")) == "").alias("empty_strings"),
            F.count("v").alias("distinct_values"), sum_of(F.col("n") > 1).alias("repeated_rows"),
        )
        least = F.row_number().over(Window.partitionBy("place").orderBy("v"))
        shown = values.where("v is not null").select("place", "v").withColumn("k", least).where(F.col("k") <= samples)
        counted = counted.join(F.broadcast(shown.groupBy("place").agg(F.array_sort(F.collect_list("v")).alias("samples"))), "place", "left")
        if repeats is not None:
            wanted = [i for i, n in enumerate(df.columns) if n in repeats]
            counted = counted.withColumn("repeated_rows", F.when(F.col("place").isin(wanted), F.col("repeated_rows")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rate = F.when(F.col("rows") > 0, F.round(F.col("nulls") / F.col("rows"), 6)).otherwise(F.lit(0.0))
    out = F.broadcast(listed).join(counted, "place", "left")
    return out.select(F.lit(table).alias("table"), "column", "dtype", zero("rows"), zero("nulls"), rate.alias("null_rate"), zero("empty_strings"), zero("distinct_values"), "repeated_rows", "samples")


def profile_tables(tables: Mapping[str, DataFrame], approx: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile(df, name, approx) for name, df in tables.items()])


def profile_issues(profiles: DataFrame) -> DataFrame:
    """(table, field, issue, rows): the columns of ``profiles`` that hold nulls or empty texts; clean ones do not appear."""
    kinds = [F.when(F.col(c) > 0, F.struct(F.lit(i).alias("issue"), F.col(c).alias("rows"))) for i, c in (("null_values", "nulls"), ("empty_strings", "empty_strings"))]
    return profiles.select("table", F.col("column").alias("field"), F.array_compact(F.array(*kinds)).alias("_i")).select("table", "field", F.inline("_i"))


def overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, columns, duplicate_rows): duplicate rows beyond the first of each kind."""
    def one(name: str, df: DataFrame) -> DataFrame:
        groups = df.groupBy(*df.columns).count()
        return groups.agg(F.lit(name).alias("table"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))

    return reduce(DataFrame.union, [one(n, d) for n, d in tables.items()])


def key_candidates(profiles: DataFrame) -> DataFrame:
    """Key-like columns with a score: 0.55 uniqueness + 0.25 completeness + 0.20 for the name; primary, lookup or low."""
    names = [r["column"] for r in profiles.select("column").distinct().collect()]
    keys = [n for n in names if is_key_name(n)]
    filled = F.col("rows") - F.col("nulls")
    unique = F.when(filled > 0, F.col("distinct_values") / filled).otherwise(F.lit(0.0))
    complete = F.when(F.col("rows") > 0, filled / F.col("rows")).otherwise(F.lit(0.0))
    score = F.round(0.55 * unique + 0.25 * complete + 0.20, 4)
    level = F.when((unique >= 0.999) & (complete >= 0.999), "primary").when(score >= 0.6, "lookup").otherwise("low")
    return profiles.where(F.col("column").isin(keys)).select("table", "column", F.round(unique, 4).alias("uniqueness"), F.round(complete, 4).alias("completeness"), score.alias("score"), level.alias("level"))


def _related(sides: Sequence[tuple[str, DataFrame]], pairs: Sequence[tuple[int, str, int, str]], samples: int) -> DataFrame:
    """One row for each pair (place of the left table, its field, place of the right one, its field).

    Fields that meet in a pair form a group. All fields of all tables go into one index, (group, key) with a count for each
    field of the group, in one shuffle with partial sums; figures and samples of every pair follow from it.
    """
    spark = sides[0][1].sparkSession
    group: dict[tuple[int, str], int] = {}
    for a, x, b, y in pairs:
        g = min(group.get((a, x), len(group)), group.get((b, y), len(group)))
        joined = {group.get((a, x)), group.get((b, y))}
        group.update({s: g for s in [*(s for s, old in group.items() if old in joined), (a, x), (b, y)]})
    place: dict[tuple[int, str], int] = {}
    for s, g in group.items():
        place[s] = sum(group[t] == g for t in place)
    cells = []
    for i, (_, df) in enumerate(sides):
        mine = [(c, group[i, c], place[i, c]) for c in df.columns if (i, c) in group]
        if mine:
            cells.append(df.select(F.inline(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).alias("p"), normalize_key(F.col(f"`{c}`")).alias("k")) for c, g, p in mine]))))
    key = F.when(F.col("k") != "", F.col("k")).alias("k")
    counts = [F.count(F.when(F.col("p") == p, 1)).alias(f"n{p}") for p in range(max(place.values()) + 1)]
    index = reduce(DataFrame.unionByName, cells).select("g", "p", key).groupBy("g", "k").agg(*counts)
    wanted = spark.createDataFrame([(n, group[a, x], place[a, x], place[b, y]) for n, (a, x, b, y) in enumerate(pairs)], "pair int, g int, i int, j int")
    n_of = F.array(*[F.col(f"n{p}") for p in range(len(counts))])
    met = index.join(F.broadcast(wanted), "g").select("pair", "k", F.get(n_of, F.col("i")).alias("nl"), F.when(F.col("k").isNotNull(), F.get(n_of, F.col("j"))).otherwise(F.lit(0)).alias("nr"))
    has, got = F.col("k").isNotNull() & (F.col("nl") > 0), F.col("nr") > 0
    total = lambda test, n: F.coalesce(F.sum(F.when(test, F.col(n))), F.lit(0))
    every = F.lit(True)
    sums = met.groupBy("pair").agg(
        F.count(F.when(has, 1)).alias("left_keys"), F.count(F.when(has & got, 1)).alias("matched_keys"), total(has, "nl").alias("left_rows"), total(has & got, "nl").alias("matched_rows"),
        F.count(F.when(F.col("nr") > 1, 1)).alias("right_repeated_keys"), F.coalesce(F.max(F.when(has, F.col("nl"))), F.lit(0)).alias("l"), F.coalesce(F.max("nr"), F.lit(0)).alias("r"),
        F.coalesce(F.sum(F.col("nl") * F.greatest("nr", F.lit(1))), F.lit(0)).alias("output_rows"), total(every, "nl").alias("all_rows"), F.max(F.when(has & got, F.col("nr"))).alias("most"),
    )
    kinds = F.array_compact(F.array(F.when(has & ~got, 0), F.when(F.col("nr") > 1, 1)))
    least = F.row_number().over(Window.partitionBy("pair", "kind").orderBy("k"))
    shown = met.select("pair", "k", F.explode(kinds).alias("kind")).withColumn("at", least).where(F.col("at") <= samples)
    of_kind = lambda n: F.array_sort(F.collect_list(F.when(F.col("kind") == n, F.col("k"))))
    shown = shown.groupBy("pair").agg(of_kind(0).alias("unmatched_samples"), of_kind(1).alias("repeated_samples"))
    named = spark.createDataFrame([(n, sides[a][0], x, sides[b][0], y) for n, (a, x, b, y) in enumerate(pairs)], "pair int, left_table string, left_field string, right_table string, right_field string")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 4)).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = F.concat(F.when(F.col("l") > 1, "N").otherwise("1"), F.lit(":"), F.when(F.col("r") > 1, "N").otherwise("1"))
    rate, none = share("matched_rows", "left_rows"), F.array().cast("array<string>")
    return F.broadcast(named).join(sums, "pair", "left").join(F.broadcast(shown), "pair", "left").select(
        "left_table", "left_field", "right_table", "right_field", zero("left_keys").alias("left_keys"), zero("matched_keys").alias("matched_keys"), share("matched_keys", "left_keys").alias("match_rate"),
        (zero("left_keys") - zero("matched_keys")).alias("unmatched_keys"), zero("left_rows").alias("left_rows"), zero("matched_rows").alias("matched_rows"), rate.alias("row_match_rate"),
        (zero("l") > 1).alias("left_repeats"), (zero("r") > 1).alias("right_repeats"), zero("right_repeated_keys").alias("right_repeated_keys"), kind.alias("cardinality"),
        zero("output_rows").alias("output_rows"), (zero("output_rows") - zero("all_rows")).alias("growth"), zero("most").alias("most_matches"),
        F.coalesce("unmatched_samples", none).alias("unmatched_samples"), F.coalesce("repeated_samples", none).alias("repeated_samples"),
        F.when(rate >= 0.8, "recommended").when(rate >= 0.5, "possible").otherwise("unlikely").alias("advice"),
    )


def relationship(left: DataFrame, left_field: str, right: DataFrame, right_field: str, left_table: str = "left", right_table: str = "right", samples: int = 10) -> DataFrame:
    """How two fields relate, from counts by key (folded as ``lookup`` folds them): one row.

    ``match_rate`` is over distinct keys, ``row_match_rate`` over rows, which the advice follows. ``output_rows`` and
    ``growth`` are what a left join would yield. Samples are the least keys of the left side without a partner, and the
    least keys that repeat on the right side.
    """
    return _related([(left_table, left), (right_table, right)], [(0, left_field, 1, right_field)], samples)


def relationships(tables: Mapping[str, DataFrame], samples: int = 10) -> DataFrame:
    """All pairs of key-like fields of the same normalised name in two tables, in both directions, from one shuffle."""
    sides = list(tables.items())
    pairs = [
        (a, x, b, y) for a, (_, left) in enumerate(sides) for b, (_, right) in enumerate(sides) if a != b
        for x in left.columns if is_key_name(x) for y in right.columns if normalize_name(x) == normalize_name(y) != ""
    ]
    return _related(sides, pairs, samples) if pairs else sides[0][1].sparkSession.createDataFrame([], RELATION)


def base_table(row_counts: Mapping[str, int]) -> str | None:
    """The table to enrich: a telling name (raw, main, detail) first, then most rows; never an empty one."""
    full = {t: n for t, n in row_counts.items() if n > 0}
    return max(full, key=lambda t: (any(w in t.lower() for w in ("raw", "main", "detail", "明细", "主表")), full[t], t), default=None)


def detail_side(a: str, a_unique: bool, b: str, b_unique: bool) -> str:
    """Of two tables with a shared key, the one in which it repeats is the base."""
    return b if a_unique and not b_unique else a


def recommend_lookups(tables: Mapping[str, DataFrame], base: str, relations: Sequence[Mapping]) -> list[dict]:
    """Lookups that bring fields the base lacks, from recommended relationships, with a duplicate policy for each."""
    have, out = {normalize_name(c) for c in tables[base].columns}, []
    for r in relations:
        if r["left_table"] != base or r["advice"] != "recommended":
            continue
        right = tables[r["right_table"]]
        fields = [c for c in right.columns if normalize_name(c) not in have]
        if not fields:
            continue
        policy = "first"
        if r["right_repeats"]:
            bad = right.agg(*[(F.count(F.col(f"`{c}`")) - F.count(to_number(F.col(f"`{c}`")))).alias(f"n{i}") for i, c in enumerate(fields)]).first()
            policy = "aggregate" if all(x == 0 for x in bad) else "review"
        out.append({"table": r["right_table"], "left_key": r["left_field"], "right_key": r["right_field"], "fields": fields, "policy": policy})
        have |= {normalize_name(c) for c in fields}
    return out


def matching_diagnostics(df_or_spark, relations: Sequence[Mapping], chosen: Sequence[Mapping]) -> DataFrame:
    """Each relationship with what was decided and why."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    used = {(c["table"], c["left_key"]) for c in chosen}
    rows = [(r["left_table"], r["left_field"], r["right_table"], "recommended" if (r["right_table"], r["left_field"]) in used else "skipped",
             "used" if (r["right_table"], r["left_field"]) in used else "match rate too low" if r["advice"] != "recommended" else "brings nothing new") for r in relations]
    return spark.createDataFrame(rows, "left_table string, left_field string, right_table string, decision string, reason string")


#: Parts of column names that make a field critical.
CRITICAL_TOKENS = ("id", "code", "key", "amount", "date", "status", "编号", "编码", "金额", "日期", "状态", "邮箱", "地址")


def critical_fields(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(t in c.lower() for t in CRITICAL_TOKENS)]


def recommend_rules(profiles: Sequence[Mapping], lookups: Sequence[Mapping] = (), keys: Sequence[str] = ()) -> list[Rule]:
    """Blank checks (errors on critical fields, warnings from 5 % blanks on), unmatched lookups and repeated keys."""
    critical, out = set(critical_fields([p["column"] for p in profiles])), []
    for p in profiles:
        rate = (p["nulls"] + p["empty_strings"]) / p["rows"] if p["rows"] else 0.0
        if p["column"] in critical or rate >= 0.05:
            out.append(Rule(f"{p['column']} blank", p["column"], "is_blank", reason=f"{p['column']}_blank", severity="error" if p["column"] in critical else "warn"))
    out += [Rule(f"{x['table']} not found", f"{x['table']}_matched", "lookup_missing", reason=f"{x['table']}_not_found", severity="error") for x in lookups]
    return out + [Rule(f"{k} repeated", k, "duplicated", reason=f"{k}_duplicated", severity="warn") for k in keys]


def cleaning_plan(spark, profiles: Sequence[Mapping], rules: Sequence[Rule], lookups: Sequence[Mapping]) -> DataFrame:
    """For each field its issues, the rules on it and the lookups that use it."""
    rows = []
    for p in profiles:
        issues = [n for n, k in (("missing", p["nulls"]), ("empty text", p["empty_strings"]), ("repeated", p.get("repeated_rows") or 0)) if k]
        rows.append((p["table"], p["column"], issues, [r.name for r in rules if r.field == p["column"]], [x["table"] for x in lookups if x["left_key"] == p["column"]]))
    return spark.createDataFrame(rows, "table string, field string, issues array<string>, rules array<string>, lookups array<string>")


def rule_impact(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """(rule, reason, severity, hits, rate): one pass for all rules. With ``keys`` also sample_keys, the least record hit."""
    marked, tests = with_repeats(df, [r.condition() for r in rules])
    key = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys])
    flagged = marked.select(key.alias("key"), *[condition(t, marked.columns).alias(f"r{i}") for i, t in enumerate(tests)])
    sums = flagged.agg(F.count(F.lit(1)).alias("rows"), *[x for i in range(len(rules)) for x in (F.count(F.when(F.col(f"r{i}"), 1)).alias(f"n{i}"), F.min(F.when(F.col(f"r{i}"), F.col("key"))).alias(f"k{i}"))])
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.reason).alias("reason"), F.lit(r.severity).alias("severity"), F.col(f"n{i}").alias("hits"), F.col(f"k{i}").alias("sample_key")) for i, r in enumerate(rules)])
    rate = F.when(F.col("rows") > 0, F.round(F.col("hits") / F.col("rows"), 6)).otherwise(0.0)
    return sums.select("rows", F.inline(each)).select("rule", "reason", "severity", "hits", rate.alias("rate"), *(["sample_key"] if keys else []))


class RemovalNotConfirmed(RuntimeError):
    """A step would remove more rows than it may without confirmation."""


def guard_removal(before: DataFrame, after: DataFrame, max_ratio: float = 0.25, confirmed: bool = False) -> tuple[int, int]:
    """(rows before, rows removed); raises from ``max_ratio`` on, unless confirmed."""
    n = before.count()
    gone = n - after.count()
    if n and gone / n >= max_ratio and not confirmed:
        raise RemovalNotConfirmed(f"{gone} of {n} rows would go")
    return n, gone


def numeric_columns(df: DataFrame, share: float = 0.8) -> list[str]:
    """Columns of numeric type, or text of which ``share`` reads as plain numbers; keys are left out."""
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if not is_key_name(c)]
    texts = [c for c in names if kinds[c] == "string"]
    rates = df.agg(*[F.avg(F.when(~is_blank(F.col(f"`{c}`")), to_number(F.col(f"`{c}`")).isNotNull().cast("int"))).alias(c) for c in texts]).first() if texts else {}
    return [c for c in names if kinds[c].startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")) or (c in texts and (rates[c] or 0) >= share)]

