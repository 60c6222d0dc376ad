"""Profiles in parts: states that are made once for each part of a table, stored, and united without reading it again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, to_number

#: Standard error of distinct counts (sketches of 2^12 entries), and rank error of quantiles (k = 200, 99 % confidence).
DISTINCT_ERROR, RANK_ERROR = 0.0163, 0.0133


def first_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; the window is cut off in every task before rows move."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most)


def listed(df: DataFrame, by: Sequence[str], output: str) -> DataFrame:
    """The values ``v`` that ``first_of_each`` left, as one list a group."""
    numbered = F.array_sort(F.collect_list(F.struct("_n", "v")))
    return df.groupBy(*by).agg(F.transform(numbered, lambda x: x["v"]).alias(output))


def profile_states(df: DataFrame, part: Column | str, order_by: Sequence[str], samples: int = 3) -> DataFrame:
    """(part, column, ...): one row of counts, sketches and first values for each column of each part.

    One aggregate with partial sums over all columns; of samples a task sends ``samples`` values a column and part.
    ``part`` names the part of a row (a day, a file), nulls are a part of their own; ``order_by`` says what comes first in it.
    Texts that read as plain numbers count as numbers. A table without rows has no states.
    """
    names = df.columns
    at = (F.col(f"`{part}`") if isinstance(part, str) else part).cast("string")
    cells, aggregates = [], []
    for i, (n, kind) in enumerate(df.dtypes):
        c = F.col(f"`{n}`")
        s, number = c.cast("string"), to_number(c)
        number = F.when(~F.isnan(number), number)
        cells.append(F.struct(F.lit(i).alias("place"), s.alias("v")))
        aggregates.append(
            F.struct(
                F.lit(i).alias("place"), F.lit(n).alias("column"), F.lit(kind).alias("dtype"), F.count(F.lit(1)).alias("rows"), F.count(F.when(s.isNull(), 1)).alias("nulls"),
                F.count(F.when(strip(s) == "", 1)).alias("empty_strings"), F.count(number).alias("numbers"), F.min(number).alias("least"), F.max(number).alias("most"), F.sum(number).alias("total"),
                F.hll_sketch_agg(s).alias("distinct_sketch"), F.kll_sketch_agg_double(number).alias("number_sketch"),
            )
        )
    states = df.groupBy(at.alias("part")).agg(F.array(*aggregates).alias("_a")).select("part", F.inline("_a"))
    order = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order_by)]
    values = df.select(at.alias("part"), *order, F.array(*cells).alias("_c")).select("part", *[f"_o{i}" for i in range(len(order))], F.inline("_c")).where("v is not null")
    first = listed(first_of_each(values, ["part", "place"], [F.col(f"_o{i}") for i in range(len(order))] + [F.col("v")], samples), ["part", "place"], "first")
    first = first.withColumnsRenamed({"part": "_part", "place": "_place"})
    joined = states.join(first, states["part"].eqNullSafe(first["_part"]) & (states["place"] == first["_place"]), "left")
    return joined.select("part", *[c for c in states.columns if c != "part"], F.coalesce("first", F.array().cast("array<string>")).alias("first"))


def unite(states: DataFrame, part: str | None = None, samples: int = 3) -> DataFrame:
    """States of many parts as those of one, named ``part``. First values come from the parts in the order of their names.

    States of the same column must have the same type; where it changed, both types keep a row of their own.
    """
    by = ["place", "column", "dtype"]
    sums = states.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "empty_strings", "numbers")], F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
    )
    values = states.select("part", *by, F.posexplode("first").alias("at", "v"))
    first = listed(first_of_each(values, by, [F.col("part"), F.col("at")], samples), by, "first")
    out = sums.join(first, by, "left").withColumn("first", F.coalesce("first", F.array().cast("array<string>")))
    return out.select(F.lit(part).cast("string").alias("part"), *[c for c in out.columns])


def profile_of(states: DataFrame, table: str = "table", quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What states say: counts are exact, ``distinct_values`` and ``quantiles`` within the errors above.

    A distinct count is never more than the values there are. ``mean`` and ``quantiles`` are null for columns without numbers.
    """
    filled = F.col("rows") - F.col("nulls")
    some = F.col("numbers") > 0
    rate = F.when(F.col("rows") > 0, F.round(F.col("nulls") / F.col("rows"), 6)).otherwise(F.lit(0.0))
    at = [F.kll_sketch_get_quantile_double(F.col("number_sketch"), F.lit(float(q))) for q in quantiles]
    return states.select(
        F.lit(table).alias("table"), "part", "column", "dtype", "rows", "nulls", rate.alias("null_rate"), "empty_strings", F.least(F.hll_sketch_estimate("distinct_sketch"), filled).alias("distinct_values"),
        "numbers", "least", "most", F.when(some, F.col("total") / F.col("numbers")).alias("mean"), F.when(some, F.array(*at)).alias("quantiles"), F.col("first").alias("samples"),
    )
