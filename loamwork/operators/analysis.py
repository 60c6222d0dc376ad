"""Small tables that describe a result: distributions, rates, trends and the sentences drawn from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_date_name, is_key_name, number, once, parse_date, strip
from .rules import ISSUES, run_counts
from .segments import exact_quantiles, exact_sum
from .summarize import top_rows


def _with_share(counts: DataFrame, n: str = "rows") -> DataFrame:
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col(n) / F.col("_total"), 4)).drop("_total")


def status_distribution(df: DataFrame, status: str) -> DataFrame:
    """(status, rows, share)"""
    return _with_share(df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("rows")))


def exception_distribution(df: DataFrame) -> DataFrame:
    """(reason, rows, share) over all issues; reasons without rows don't appear."""
    return _with_share(df.select(F.explode(ISSUES).alias("i")).groupBy(F.col("i.reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows")))


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, missing, rate): nulls and blanks, in one pass."""
    names = list(columns or df.columns)
    sums = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(is_blank(F.col(f"`{c}`")), 1)).alias(c) for c in names])
    rate = F.when(F.col("_rows") > 0, F.least(F.lit(1.0), F.round(F.col("missing") / F.col("_rows"), 4))).otherwise(F.lit(0.0))
    return sums.unpivot(["_rows"], names, "field", "missing").select("field", "missing", rate.alias("rate"))


def match_rates(relations: DataFrame) -> DataFrame:
    return relations.select(F.concat_ws(" -> ", F.concat_ws(".", "left_table", "left_field"), F.concat_ws(".", "right_table", "right_field")).alias("relationship"), "left_keys", "matched_keys", "match_rate")


def dimension_columns(df: DataFrame, most: int = 3) -> list[str]:
    """Up to three text columns with 2 to min(20, 70 % of the rows) distinct values. One aggregate."""
    names = [n for n, t in df.dtypes if t == "string" and not is_key_name(n)]
    if not names:
        return []
    r = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_distinct(F.col(f"`{n}`")).alias(n) for n in names]).first()
    return [n for n in names if 2 <= r[n] <= min(20, 0.7 * r["_rows"])][:most]


def group_distribution(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5, blank: str = "未填写") -> DataFrame:
    """(dimension, category, rows): the most frequent categories of each column."""
    names = list(columns if columns is not None else dimension_columns(df))
    if not names:
        return df.sparkSession.createDataFrame([], "dimension string, category string, rows long")
    cells = df.select(*[F.when(is_blank(F.col(f"`{n}`")), blank).otherwise(strip(F.col(f"`{n}`").cast("string"))).alias(n) for n in names]).unpivot([], names, "dimension", "category")
    return top_rows(cells.groupBy("dimension", "category").agg(F.count(F.lit(1)).alias("rows")), "rows", top, ["category"], ["dimension"])


def _measures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``numeric_summary`` before it is rounded."""
    kinds, names = dict(df.dtypes), [c for c in columns if not is_key_name(c)]
    if not names:
        return df.sparkSession.createDataFrame([], "field string, n long, total double, mean double, least double, most double, p90 double")
    numeric = {c: number(F.col(f"`{c}`"), "business") if kinds[c] == "string" else F.col(f"`{c}`") for c in names}
    known = exact_quantiles(df, numeric, [0.0, 0.9, 1.0])

    def one(i: int, c: str):
        x, (least, p90, most) = F.col(f"_v{i}"), known[c]
        total = exact_sum(x, None if most is None else max(abs(least), abs(most)))
        return F.struct(F.lit(c).alias("field"), F.count(x).alias("n"), total.alias("total"), F.try_divide(total, F.count(x)).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.lit(p90).cast("double").alias("p90"))

    read = df.select(*[x.cast("double").alias(f"_v{i}") for i, x in enumerate(numeric.values())])
    return read.agg(F.array(*[one(i, c) for i, c in enumerate(numeric)]).alias("a")).select(F.inline("a")).where("n >= 2")


def _four_decimals(measures: DataFrame) -> DataFrame:
    return measures.select("field", "n", *[F.round(c, 4).alias(c) for c in ("total", "mean", "least", "most", "p90")])


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n, total, mean, least, most, p90) of columns with two numbers at least, read as business numbers; rounded to 4.

    Columns named as keys hold no measures; if there are no others the result is empty. Totals don't depend on the order
    in which rows are added.
    """
    return _four_decimals(_measures(df, columns))


def monthly_trend(df: DataFrame, column: str | None = None) -> DataFrame:
    """(month, rows) of a date column; by default the first date-named one that mostly parses."""
    kinds = dict(df.dtypes)
    parsed = lambda c: F.col(c) if kinds[c].startswith(("timestamp", "date")) else parse_date(F.col(c))
    if column is None:
        names = [c for c in df.columns if is_date_name(c)]
        r = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(parsed(c)).alias(c) for c in names]).first()
        column = next((c for c in names if r[c] >= max(3, 0.5 * r["_rows"])), None)
        if column is None:
            return df.sparkSession.createDataFrame([], "month string, rows long")
    return df.select(F.date_format(parsed(column), "yyyy-MM").alias("month")).where("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


def cross_issues(df: DataFrame, dimension: str, top: int = 20) -> DataFrame:
    """(dimension, reason, rows): the most frequent pairs."""
    each = df.select(F.col(dimension).alias("dimension"), F.explode(F.array_distinct(F.transform(ISSUES, lambda x: x["reason"]))).alias("reason"))
    return top_rows(each.groupBy("dimension", "reason").agg(F.count(F.lit(1)).alias("rows")), "rows", top, ["dimension", "reason"])


def scatter_points(df: DataFrame, x: str, y: str, order_by: Sequence[str], most: int = 200) -> DataFrame:
    """The first complete pairs, in order: a chart's worth."""
    return df.select(x, y, *[c for c in order_by if c not in (x, y)]).dropna(subset=[x, y]).orderBy(*order_by).limit(most).select(x, y)


def _sentences(df: DataFrame, topic: str, pattern: str, *values) -> DataFrame:
    return df.select(F.lit(topic).alias("topic"), F.format_string(pattern, *[F.col(v) if isinstance(v, str) else v for v in values]).alias("finding"))


def _two_decimals(c: Column) -> Column:
    """A double's exact value to two decimals, an exact half to the even one, as ``printf`` of SQL and C writes it.

    Java's formatter rounds the shortest text of a double, and its halves up. All steps here are exact: from 2**53 doubles
    have no decimals, and below, the head of a fraction has 25 bits and its tail no more than 36 that count.
    """

    def cents(rest: Column) -> Column:
        head = F.floor(rest * 2.0**25) / 2.0**25
        low, over = F.floor(head * 100), head * 100 % 1.0 - 0.5 + (rest - head) * 100
        return low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)

    x = F.abs(c)
    hundredths = F.floor(x) * 100 + once(x % 1.0, cents)
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, (hundredths.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string"))
    return F.when(x < 2.0**53, text).otherwise(F.format_string("%.2f", c))


def findings(
    status: DataFrame, missing: DataFrame, exceptions: DataFrame, *, counts: DataFrame | None = None, matches: DataFrame | None = None, groups: DataFrame | None = None,
    numbers: DataFrame | None = None, trend: DataFrame | None = None, cross: DataFrame | None = None, points: DataFrame | None = None,
) -> DataFrame:
    """Sentences drawn from small tables, as rows (topic, finding). A table without rows says nothing.

    ``counts`` is that of ``run_counts``; ``matches``, ``groups``, ``numbers``, ``trend``, ``cross`` and ``points`` those of
    ``match_rates``, ``group_distribution``, ``numeric_summary``, ``monthly_trend``, ``cross_issues`` and ``scatter_points``.
    Where one row is named for its rank, equals are told apart by name (the earliest month, the first category).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    out = [
        _sentences(status, "status", "%s: %d rows (%.1f %%)", text("status"), "rows", F.col("share") * 100),
        _sentences(missing.where("missing > 0"), "missing", "%s is missing in %d rows (%.1f %%)", "field", "missing", F.col("rate") * 100),
        _sentences(exceptions, "exceptions", "%s: %d rows", text("reason"), "rows"),
    ]
    if counts is not None:
        share = lambda c: F.when(F.col("output") > 0, F.col(c) / F.col("output") * 100).otherwise(F.lit(0.0))
        out.append(_sentences(counts, "counts", "of %d rows %d are usable (%.1f %%) and %d need review (%.1f %%)", "output", "valid", share("valid"), "abnormal", share("abnormal")))
    if matches is not None:
        weakest = matches.where("match_rate is not null").orderBy("match_rate", "relationship").limit(1)
        out.append(_sentences(weakest, "matches", "%s matches the fewest keys: %d of %d (%.1f %%)", "relationship", "matched_keys", "left_keys", F.col("match_rate") * 100))
    if groups is not None:
        out.append(_sentences(top_rows(groups, "rows", 1, ["category"], ["dimension"]), "groups", "%s is most often %s: %d rows", "dimension", "category", "rows"))
    if numbers is not None:
        out.append(_sentences(numbers, "numbers", "%s: %d numbers from %s to %s, total %s, mean %s, nine in ten up to %s", "field", "n", *[_two_decimals(F.col(c)) for c in ("least", "most", "total", "mean", "p90")]))
    if trend is not None:
        ends = trend.agg(F.max_by(F.struct("month", "rows"), "month").alias("last"), F.max_by(F.struct("month", "rows"), F.struct(F.col("rows"), -F.regexp_replace("month", "-", "").cast("long"))).alias("top"))
        out.append(_sentences(ends.where("last is not null"), "trend", "the last month, %s, has %d rows; most, %d, are in %s", "last.month", "last.rows", "top.rows", "top.month"))
    if cross is not None:
        out.append(_sentences(top_rows(cross, "rows", 1, ["dimension", "reason"]), "cross", "%s has most rows with %s: %d", text("dimension"), "reason", "rows"))
    if points is not None:
        x, y = points.columns
        r = points.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")).alias("r")).where("n > 1 and r is not null and not isnan(r)")
        out.append(_sentences(r, "points", "%s and %s: correlation %s in %d points", F.lit(x), F.lit(y), _two_decimals(F.col("r")), "n"))
    return reduce(DataFrame.unionByName, out)


def analyse(
    df: DataFrame, status: str, *, dimension: str | None = None, measures: Sequence[str] = (), date: str | None = None, points: tuple[str, str] | None = None,
    order_by: Sequence[str] = (), relations: DataFrame | None = None, policy: Mapping | None = None,
) -> dict[str, DataFrame]:
    """All tables of this module for a table with ``issues``, by name, and ``findings`` drawn from them.

    ``dimension`` crosses with issues, and is the column of ``groups``; without it both are left out or found by
    ``dimension_columns``. ``points`` needs ``order_by``. What a table does not have is left out, not empty.
    """
    plain = df.drop(ISSUES)
    made = {
        "status": status_distribution(df, status), "missing": missing_rates(plain), "exceptions": exception_distribution(df),
        "counts": run_counts(df, **(policy or {})), "groups": group_distribution(plain, [dimension] if dimension else None),
    }
    if relations is not None:
        made["matches"] = match_rates(relations)
    if measures:
        measured = _measures(plain, measures)
        made["numbers"] = _four_decimals(measured)
    if date or any(is_date_name(c) for c in plain.columns):
        made["trend"] = monthly_trend(plain, date)
    if dimension:
        made["cross"] = cross_issues(df, dimension)
    if points:
        if not order_by:
            raise ValueError("points need an order")
        made["points"] = scatter_points(plain, *points, order_by)
    told = {**made, "numbers": measured} if measures else made  # a number rounded twice may end on the wrong side
    return {**made, "findings": findings(**told)}
