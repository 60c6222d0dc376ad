"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, Callable]:
    found: dict[str, tuple[Callable, str | None]] = {}

    def query(*names: str, sql: str | None = None):
        """Register under the function's own name; it gets the named tables."""

        def add(f):
            found[f.__name__] = (lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names]), sql)
            return f

        return add

    return found, query
