"""Streaming forms of operators: duplicates within a watermark, windowed counts, rules on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import ISSUES, Rule, apply_rules


def dedupe_stream(stream: DataFrame, keys: Sequence[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """The first event of each key; state is kept as long as late events may come."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, window: str = "1 hour", keys: Sequence[str] = (), lateness: str = "10 minutes") -> DataFrame:
    """(window_start, keys, rows) in tumbling event-time windows."""
    counted = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "rows")


def windowed_issues(stream: DataFrame, rules: Sequence[Rule], time: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, reason, rows): issues by rule. Rules must be row-local."""
    each = apply_rules(stream, rules).select(time, F.explode(F.transform(ISSUES, lambda x: x["reason"])).alias("reason"))
    return windowed_counts(each, time, window, ["reason"], lateness)
