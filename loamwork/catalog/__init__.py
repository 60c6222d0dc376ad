"""All registered queries of the library's own operators, with the SQL they are held against.

The driver's tables are clean, so defects are put in by expressions on the keys, the same in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, covering, further, joins, scalars, tables

_MODULES = (scalars, joins, tables, checks, further, covering)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, (f, _) in m.REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.REGISTERED.items() if sql}
