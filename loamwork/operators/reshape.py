"""Renames, value maps, unpivots, splits, projections, unions and masks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, is_sensitive_name, normalize_name, strip
from .rows import ROW_ID, with_row_id

MANY_VALUES = 500


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def map_values(df: DataFrame, column: str, values: Mapping[str, str]) -> DataFrame:
    """``<column>_mapped``; what isn't mapped keeps its value. Keys are compared as text; of equal ones the last counts. Large
    maps are joined instead of put into the plan."""
    c, values = F.col(f"`{column}`").cast("string"), {str(k): str(v) for k, v in values.items()}
    if not values:
        return df.withColumn(f"{column}_mapped", c)
    if len(values) <= MANY_VALUES:
        return df.withColumn(f"{column}_mapped", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), c))
    table = df.sparkSession.createDataFrame(list(values.items()), "_from string, _to string")
    return df.join(table, c == F.col("_from"), "left").withColumn(f"{column}_mapped", F.coalesce("_to", c)).drop("_from", "_to")


def project(df: DataFrame, schema: Sequence[str]) -> DataFrame:
    """Exactly these columns, in this order; missing ones are empty strings."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit("").alias(n) for n in schema])


def blank_columns(df: DataFrame) -> DataFrame:
    """(column, blank): whether all values are null or white space. One pass for all columns."""
    tests = [F.coalesce(F.max(F.when(~is_blank(F.col(f"`{c}`")), 1)), F.lit(0)).alias(c) for c in df.columns]
    return df.agg(*tests).unpivot([], df.columns, "column", "_full").select("column", (F.col("_full") == 0).alias("blank"))


def is_template(df: DataFrame) -> bool:
    """At least two named columns and no value."""
    named = [c for c in df.columns if c.strip() and not c.lower().startswith("unnamed:")]
    return len(named) >= 2 and df.where(reduce(lambda a, b: a | b, [~is_blank(F.col(f"`{c}`")) for c in df.columns])).isEmpty()


def template_schema(tables: Mapping[str, DataFrame]) -> list[str] | None:
    """The columns of the only header-only table; with none or several, nothing."""
    found = [df for df in tables.values() if is_template(df)]
    return found[0].columns if len(found) == 1 else None


def drop_technical(df: DataFrame, first: Sequence[str] = (), source_columns: Sequence[str] = ()) -> DataFrame:
    """Without process columns (``_...``, record keys, ``..._std``, ``is_active...``), ``first`` ones first; source columns stay."""
    technical = re.compile(r"^(_.*|record_key|record_id|source_table|source_row_index|.*_std|is_active.*)$")
    kept = [c for c in df.columns if c in source_columns or c in first or not technical.match(c)]
    return df.select(*[c for c in first if c in kept], *[c for c in kept if c not in first])


def import_view(df: DataFrame, required: Sequence[str], status: str = "ready", reason: str = "") -> tuple[DataFrame, DataFrame]:
    """(view, mapping): the required import fields, found by tolerant names, with status and reason columns."""
    def plain(name: str) -> str:
        return re.sub(r"[\s_\-]+", "", name.lower())

    by_plain = {plain(c): c for c in reversed(df.columns)}
    pairs = [(f, f if f in df.columns else by_plain.get(plain(f))) for f in required]
    view = df.select(*[(F.col(f"`{s}`") if s else F.lit("")).alias(f) for f, s in pairs], F.lit(status).alias("import_status"), F.lit(reason).alias("import_reason"))
    mapping = df.sparkSession.createDataFrame([(f, s or "", "mapped" if s else "missing") for f, s in pairs] or [("", "", "")], "import_field string, source_column string, status string")
    return view, mapping if pairs else mapping.limit(0)


def unpivot(df: DataFrame, values: Sequence[str], variable: str, value: str) -> DataFrame:
    """Wide to long; nothing is dropped, nulls stay."""
    return df.unpivot([c for c in df.columns if c not in values], list(values), variable, value)


def wide_columns(df: DataFrame, least: int = 3) -> list[str]:
    """Numeric columns whose names differ only in digits: the largest such group of at least ``least``. Schema only."""
    shapes: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) and re.search(r"\d", f.name):
            shapes.setdefault(re.sub(r"\d+", "#", f.name), []).append(f.name)
    best = max(shapes.values(), key=len, default=[])
    return best if len(best) >= least else []


def split_column(df: DataFrame, column: str, sep: str, parts: int, names: Sequence[str] | None = None, default: str = "") -> DataFrame:
    """One column into ``parts``; the separator is literal, missing parts are ``default``."""
    if not sep:
        raise ValueError("the separator is empty")
    names = list(names or split_names(column, parts))
    cut = F.split(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")), "\\Q" + sep + "\\E")
    return df.withColumn("_parts", cut).select("*", *[F.coalesce(F.get("_parts", F.lit(i)), F.lit(default)).alias(n) for i, n in enumerate(names[:parts])]).drop("_parts")


def split_names(column: str, parts: int, wanted: Sequence[str] = ()) -> list[str]:
    return [wanted[i] if i < len(wanted) else f"{column}_{i + 1}" for i in range(parts)]


#: Separators that are tried.
SEPARATORS = ["-", "/", "|", ",", ";", "_", ":", "，", "；", "、", " "]


def infer_separator(df: DataFrame, column: str, share: float = 0.9, most: int = 10) -> tuple[str, int] | None:
    """(separator, parts) with which at least ``share`` of the filled rows split alike. One aggregate for all candidates."""
    c = strip(F.col(f"`{column}`").cast("string"))
    filled = df.where(~is_blank(F.col(f"`{column}`")))
    counts = F.array(*[F.struct(F.lit(s).alias("sep"), (F.size(F.split(c, "\\Q" + s + "\\E"))).alias("parts")) for s in SEPARATORS])
    rows = filled.select(F.inline(counts)).groupBy("sep", "parts").count().where("parts > 1").orderBy("sep", "parts").collect()
    total = filled.count()
    good = [(r["count"], -SEPARATORS.index(r["sep"]), r["sep"], r["parts"]) for r in rows if r["parts"] <= most and r["count"] >= share * total]
    return (lambda b: (b[2], b[3]))(max(good)) if good and total else None


def trace(df: DataFrame, table: str) -> DataFrame:
    """``_source_table`` and ``_source_row_index`` (the row's ``_row_id``)."""
    return with_row_id(df).withColumn("_source_table", F.lit(table)).withColumn("_source_row_index", F.col(ROW_ID))


def simplify(df: DataFrame) -> DataFrame:
    """Without lookup helpers and ``_source_table``; the row index gets a plain name."""
    gone = [c for c in df.columns if c.startswith("_lookup_") or c == "_source_table"]
    return df.drop(*gone).withColumnRenamed("_source_row_index", "source_row")


def unionable(tables: Mapping[str, DataFrame]) -> list[list[str]]:
    """Groups of tables with the same set of column names (two or more each)."""
    groups: dict[frozenset, list[str]] = {}
    for name, df in tables.items():
        groups.setdefault(frozenset(df.columns), []).append(name)
    return [g for g in groups.values() if len(g) > 1]


def union_with_origin(tables: Mapping[str, DataFrame], origin: str = "_source_table") -> DataFrame:
    """All rows of tables with the same columns, each with the name of its table."""
    return reduce(DataFrame.unionByName, [df.withColumn(origin, F.lit(name)) for name, df in tables.items()])


def removed_rows(before: DataFrame, after: DataFrame, ids: Sequence[str] = (ROW_ID,)) -> DataFrame:
    return before.join(after, list(ids), "left_anti")


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key), key, "left_anti")


#: What an e-mail address and a phone number look like.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"^\+?[0-9][0-9 \-]{6,18}[0-9]$"


def value_pattern(c: Column) -> Column:
    """What kind of value a cell holds, without the value."""
    s = strip(c.cast("string"))
    letters, digits = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^0-9]", ""))
    return (
        F.when(is_blank(c), F.lit("")).when(s.rlike(f"^{EMAIL}$"), F.lit("<email>"))
        .when(s.rlike(r"^[0-9]+$"), F.concat(F.lit("<digits:length="), F.length(s).cast("string"), F.lit(">")))
        .otherwise(F.concat(F.lit("<text:length="), F.length(s).cast("string"), F.lit(",letters="), letters.cast("string"), F.lit(",digits="), digits.cast("string"), F.lit(">")))
    )


def mask_sensitive(df: DataFrame, mode: str = "masked", columns: Sequence[str] | None = None) -> DataFrame:
    """``raw``: as it is. ``metadata``: no rows. ``masked``: sensitive columns as patterns, by name or, elsewhere, by value."""
    if mode == "raw":
        return df
    if mode == "metadata":
        return df.limit(0)
    if mode != "masked":
        raise ValueError(f"unknown mode {mode!r}")
    named = set(columns) if columns is not None else {c for c in df.columns if is_sensitive_name(c)}
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    def shown(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name in named:
            return value_pattern(c).alias(name)
        if name in strings:
            return F.when(c.rlike(EMAIL) | strip(c).rlike(PHONE), value_pattern(c)).otherwise(c).alias(name)
        return c

    return df.select(*map(shown, df.columns))


def neutralize_formulas(df: DataFrame, trusted: Sequence[str] = ()) -> DataFrame:
    """Text cells that a spreadsheet would run (= + - @ tab, line breaks, full-width forms) get a leading apostrophe.

    Plain numbers such as -50 stay; so do columns declared as ``trusted``.
    """
    risky, plain = r"^[=+\-@\t\r\n＝＋－＠]", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    def safe(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name in trusted or not isinstance(f.dataType, T.StringType):
            return c
        return F.when(c.rlike(risky) & ~strip(c).rlike(plain), F.concat(F.lit("'"), c)).otherwise(c).alias(f.name)

    return df.select(*map(safe, df.schema.fields))


def repeated_names(names: Sequence[str]) -> list[str]:
    return [n for n, k in Counter(names).items() if k > 1]


def numbered_names(names: Sequence[str]) -> list[str]:
    """Without repeats: a name that was there before gets _2, _3 and so on."""
    out: list[str] = []
    for n in names:
        k, name = 2, n
        while name in out:
            name, k = f"{n}_{k}", k + 1
        out.append(name)
    return out


def same_field(a: str, b: str) -> bool:
    return normalize_name(a) == normalize_name(b) != ""
