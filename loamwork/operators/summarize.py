"""Group totals, crosstabs, time buckets and top rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import non_record_row
from ..functions.text import is_blank, number, parse_business_number, parse_date, time_bucket
from .rows import ROW_ID, order_of
from .segments import group_quantiles

AGGREGATES = ("count", "sum", "mean", "min", "max", "median", "nunique", "first", "last")


@dataclass(frozen=True)
class Metric:
    """``op`` of ``column`` as ``output``; text columns are read as business numbers by the numeric ones."""

    op: str
    column: str | None = None
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"{self.column or 'rows'}_{self.op}"


def metric_column(m: Metric, df: DataFrame, order_by: Sequence[str] | None = None, approx: bool = False) -> Column:
    if m.op not in AGGREGATES:
        raise ValueError(f"unknown aggregate {m.op!r}")
    if m.op == "count":
        return F.count(F.lit(1)).alias(m.name)
    c, kind = F.col(f"`{m.column}`"), dict(df.dtypes)[m.column]
    x = parse_business_number(c) if kind == "string" else c
    if m.op in ("first", "last"):
        order = F.struct(*order_of(df, order_by))
        by = F.when(c.isNotNull(), order)
        return (F.min_by(c, by) if m.op == "first" else F.max_by(c, by)).alias(m.name)
    made = {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0)),
        "mean": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "median": lambda: F.percentile_approx(x, 0.5, 10_000) if approx else F.median(x),
        "nunique": lambda: F.approx_count_distinct(c) if approx else F.count_distinct(c),
    }[m.op]()
    return made.alias(m.name)


def aggregate(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], order_by: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Totals by key; null keys are a group of their own. Without keys, one row.

    Exact medians are not aggregates of a task: they are selected by counts that run over ranges of (group, value).
    """
    medians = [m for m in metrics if m.op == "median" and not approx]
    if not medians:
        return df.groupBy(*keys).agg(*[metric_column(m, df, order_by, approx) for m in metrics])
    kinds = dict(df.dtypes)
    values = {m.name: parse_business_number(F.col(f"`{m.column}`")) if kinds[m.column] == "string" else F.col(f"`{m.column}`") for m in medians}
    found = group_quantiles(df, keys, values, 0.5)
    rest = df.groupBy(*keys).agg(*[metric_column(m, df, order_by, approx) for m in metrics if m not in medians] or [F.lit(1).alias("_one")])
    same = F.lit(True)
    for k in keys:
        same = same & rest[k].eqNullSafe(found[k])
    return rest.join(found, same, "left").select(*[rest[k] for k in keys], *[(found if m in medians else rest)[m.name] for m in metrics])


def crosstab(df: DataFrame, rows: Sequence[str], column: str, metric: Metric, values: Sequence | None = None, max_values: int = 1000) -> DataFrame:
    """Rows by the values of one column; missing combinations are 0; rows with a null key are left out.

    Give ``values`` to save the pass that finds them; more than ``max_values`` is an error.
    """
    kept = df.dropna(subset=[*rows, column])
    if values is None:
        found = [r[0] for r in kept.select(column).distinct().limit(max_values + 1).collect()]
        if len(found) > max_values:
            raise ValueError(f"{column} has over {max_values} values")
        values = sorted(found)
    return kept.groupBy(*rows).pivot(column, list(values)).agg(metric_column(metric, kept)).na.fill(0)


def top_rows(df: DataFrame, measure: str, n: int, ties: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The n rows with the highest measure, overall or within groups; ``ties`` make the order total."""
    order = [F.col(measure).desc_nulls_last(), *ties]
    if not within:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def unreadable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(measure, unreadable): values that aren't blank and are no number in any notation. One pass."""
    counts = [F.count(F.when(~is_blank(F.col(f"`{c}`")) & number(F.col(f"`{c}`"), "business").isNull(), 1)).alias(c) for c in columns]
    return df.agg(*counts).unpivot([], list(columns), "measure", "unreadable")


def record_count(df: DataFrame) -> DataFrame:
    """Distinct source records: by ``_row_id`` where there is one, else rows."""
    return df.agg((F.count_distinct(ROW_ID) if ROW_ID in df.columns else F.count(F.lit(1))).alias("records"))


def summarize(df: DataFrame, group_by: Sequence[str], metrics: Sequence[Metric], column: str | None = None, bucket: tuple[str, str] | None = None, top_n: int | None = None, rank_within: Sequence[str] = (), order_by: Sequence[str] | None = None) -> DataFrame:
    """A summary table: rows that are no records are left out, a date column may be bucketed as (column, unit)."""
    keys = list(group_by)
    kept = df.where(~non_record_row([c for c in df.columns if c != ROW_ID]))
    if bucket:
        name, unit = bucket
        date = F.col(name) if dict(df.dtypes)[name].startswith(("timestamp", "date")) else parse_date(F.col(name))
        kept = kept.withColumn(f"{name}_{unit}", time_bucket(date, unit))
        keys.append(f"{name}_{unit}")
    out = crosstab(kept, keys, column, metrics[0]) if column else aggregate(kept, keys, metrics, order_by)
    return top_rows(out, metrics[0].name, top_n, keys, rank_within) if top_n else out
