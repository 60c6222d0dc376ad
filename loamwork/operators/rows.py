"""Formulas, filters, duplicates, ranks and fills over rows."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import Formula, formula
from ..functions.predicates import Condition, all_of, filter_rows
from ..functions.repeats import mark_repeats, row_cells
from ..functions.text import NUMERIC_TYPES, parse_date, strip, text, to_number, typed_number
from ..sources.scratch import written
from .segments import last_value, running_sum

ROW_ID = "_row_id"


def with_row_id(df: DataFrame) -> DataFrame:
    """``_row_id``: increases along files and blocks of the scan. A key of the data's own is better where there is one."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def order_of(df: DataFrame, order_by: Sequence[Column | str] | None) -> list:
    """Explicit order, else ``_row_id``; rows have no order of their own, so anything else is an error."""
    if order_by:
        return list(order_by)
    if ROW_ID in df.columns:
        return [ROW_ID]
    raise ValueError("this operator depends on row order: give order_by, or add _row_id with with_row_id()")


def sortable(df: DataFrame, name: str, as_type: str | None = None) -> Column:
    """A column's sort value: numbers if any value is one, else dates, else text.

    The column's type decides; only for text, and without ``as_type``, does one aggregate look at the values.
    """
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind.startswith((*NUMERIC_TYPES, "date", "timestamp")) and as_type in (None, "number" if kind.startswith(NUMERIC_TYPES) else "date"):
        return typed_number(c, kind) if kind.startswith(NUMERIC_TYPES) else c.cast("timestamp")
    if as_type is None:
        x = to_number(c)
        numbers, dates = df.agg(F.max(x.isNotNull()), F.max(F.when(x.isNull(), parse_date(c).isNotNull()))).first()
        as_type = "number" if numbers else "date" if dates else "text"
    return {"number": to_number(c), "date": parse_date(c), "text": strip(c.cast("string"))}[as_type]


def dense_rank(df: DataFrame, output: str, source: str, partition: Sequence[str] = (), descending: bool = True, as_type: str | None = None) -> DataFrame:
    """Dense rank of a column; nulls have none.

    The distinct values are ranked, not the rows: counts of values per range are summed up to each range, with carries where
    a partition goes on in the next range, so no task holds all of a table or partition. Ranks are joined back by value.
    """
    value = sortable(df, source, as_type)
    tagged = df.withColumn("_value", value)
    order = F.col("_value").desc() if descending else F.col("_value").asc()
    distinct = tagged.where("_value is not null").select(*partition, "_value").distinct()
    if partition:
        ranks = running_sum(distinct, list(partition), [order], F.lit(1), "_rank")
        same = tagged["_value"].eqNullSafe(ranks["_value"])
        for p in partition:
            same = same & tagged[p].eqNullSafe(ranks[p])
        return tagged.join(ranks, same, "left").select(*[tagged[c] for c in df.columns if c != output], ranks["_rank"].cast("int").alias(output))
    ranks = _number_rows(distinct, [order], "_rank")
    return tagged.join(ranks, "_value", "left").withColumn(output, F.col("_rank").cast("int")).drop("_value", "_rank")


def _number_rows(df: DataFrame, order: list[Column], output: str) -> DataFrame:
    """1, 2, ... over the whole table: range partitions, sorted, with the counts of the partitions before as offsets.

    The sorted rows are written, as their partition numbers must be the same when counted and when used.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts, before, offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect(), 0, {}
    for r in counts:
        offsets[r["_part"]] = before
        before += r["n"]
    spark = df.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(offsets.items()) or [(0, 0)], "_part long, _before long"))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(known, "_part").withColumn(output, F.col("_before") + at + 1).drop("_part", "_before", "_at")


def top_n_flag(df: DataFrame, output: str, source: str, n: int, partition: Sequence[str] = (), descending: bool = True) -> DataFrame:
    ranked = dense_rank(df, "_top_rank", source, partition, descending)
    return ranked.withColumn(output, F.coalesce(F.col("_top_rank") <= n, F.lit(False))).drop("_top_rank")


def dedupe(df: DataFrame, keys: Sequence[str] = (), keep: str = "first", order_by: Sequence[Column | str] | None = None, order_column: str | None = None) -> DataFrame:
    """One row for each key: ``first``/``last`` in row order, ``latest``/``earliest`` by a column; or ``all_duplicates``.

    Null keys are equal to each other. Without keys, all columns count; then any of the equal rows will do.
    """
    names = list(keys) or [c for c in df.columns if c != ROW_ID]
    if keep == "all_duplicates":
        return mark_repeats(df, row_cells(df, names), "_again_").where("_again_").drop("_again_")
    if not keys:
        return df.dropDuplicates(names)
    if keep in ("latest", "earliest"):
        value = sortable(df, order_column)
        rest = [F.col(c) if isinstance(c, str) else c for c in order_of(df, order_by)]
        order = [value.desc_nulls_last() if keep == "latest" else value.asc_nulls_last(), *rest]
    elif keep in ("first", "last"):
        order = [F.col(c) if isinstance(c, str) else c for c in order_of(df, order_by)]
        order = [c.desc() for c in order] if keep == "last" else order
    else:
        raise ValueError(f"unknown strategy {keep!r}")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("_n = 1").drop("_n")


def fill_down(df: DataFrame, output: str, source: str, order_by: Sequence[str] | None = None, partition: Sequence[str] = ()) -> DataFrame:
    """The last value that isn't null, in order.

    Rows are range-sorted, and the values before each range are carried over (within its partition, if there is one), so
    neither a long table nor a long partition is put into one task.
    """
    order = order_of(df, order_by)
    if partition:
        return last_value(df, list(partition), [F.col(c) if isinstance(c, str) else c for c in order], source, output)
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "filled")
    part = F.shiftright("_at", 33)
    ends = placed.groupBy(part.alias("_part")).agg(F.max_by(F.struct(F.col(f"`{source}`").alias("v")), F.when(F.col(f"`{source}`").isNotNull(), F.col("_at"))).alias("s")).orderBy("_part").collect()
    carried, rows = None, []
    for r in ends:
        rows.append((r["_part"], carried))
        carried = r["s"]["v"] if r["s"] is not None and r["s"]["v"] is not None else carried
    kind = df.select(F.col(f"`{source}`").alias("_carried")).schema[0].dataType.simpleString()
    known = F.broadcast(df.sparkSession.createDataFrame(rows or [(0, None)], f"_part long, _carried {kind}"))
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_part", part).join(known, "_part").withColumn(output, F.coalesce(F.last(F.col(f"`{source}`"), ignorenulls=True).over(w), F.col("_carried"))).drop("_part", "_carried", "_at")


def conditional_totals(df: DataFrame, totals: dict[str, tuple[str | None, Sequence[Condition]]]) -> DataFrame:
    """countif(s) and sumif(s): each output is one number, the same on every row. ``None`` counts, a column name sums.

    All are computed in one aggregate, whose single row is sent to the tasks: no window over the whole table.
    """
    aggs = []
    for name, (column, conditions) in totals.items():
        test = all_of(conditions, df.columns)
        aggs.append((F.count(F.when(test, 1)) if column is None else F.coalesce(F.sum(F.when(test, to_number(F.col(f"`{column}`")))), F.lit(0.0))).alias(name))
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def xlookup(df: DataFrame, output: str, source: str, lookup: str, result: str, default=None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Look each value of ``source`` up among ``lookup`` of the same table: the first match's ``result``, else ``default``.

    Unlike in lookups between tables, blank matches blank.
    """
    order = order_of(df, order_by)
    keys = df.select(strip(text(F.col(f"`{lookup}`"))).alias("_key"), F.col(f"`{result}`").alias("_found"), F.struct(*order).alias("_order"))
    first = keys.groupBy("_key").agg(F.min_by(F.struct("_found"), "_order").alias("_hit"))
    joined = df.withColumn("_key", strip(text(F.col(f"`{source}`")))).join(first, "_key", "left")
    value = F.when(F.col("_hit").isNotNull(), F.col("_hit._found")).otherwise(F.lit(default))
    return joined.withColumn(output, value).drop("_key", "_hit")


def apply_formulas(df: DataFrame, formulas: Sequence[Formula], order_by: Sequence[str] | None = None) -> DataFrame:
    """In order, each seeing earlier outputs. An optional one that can't be analysed is left out with a warning."""
    for f in formulas:
        try:
            df = _apply(df, f, order_by)
        except Exception as e:  # analysis of one formula: unknown column, wrong arity
            if f.required:
                raise
            warnings.warn(f"formula {f.output!r} left out: {e}", stacklevel=2)
    return df


def _apply(df: DataFrame, f: Formula, order_by: Sequence[str] | None) -> DataFrame:
    if f.op == "filter_rows":
        return filter_rows(df, *(f.conditions or [Condition(f.source, "equals", f.value)]))
    if f.op == "dedupe":
        return dedupe(df, f.columns, str(f.value or "first"), order_by, f.source)
    if f.op in ("xlookup", "index_match"):
        return xlookup(df, f.output, f.source, f.columns[0], f.columns[1], f.default, order_by)
    if f.op == "sort_rank":
        return dense_rank(df, f.output, f.source, f.columns, str(f.value or "desc") != "asc")
    if f.op == "top_n":
        return top_n_flag(df, f.output, f.source, int(f.value), f.columns, str(f.default or "desc") != "asc")
    if f.op == "fill_down":
        return fill_down(df, f.output, f.source, order_by)
    if f.op in ("countif", "countifs"):
        return conditional_totals(df, {f.output: (None, f.conditions)})
    if f.op in ("sumif", "sumifs"):
        return conditional_totals(df, {f.output: (f.columns[0], f.conditions)})
    return df.withColumn(f.output, formula(f, df.columns))
