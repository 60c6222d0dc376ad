"""Conditions on one column, as Columns that are never null."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import mark_many, mark_repeats, row_cells
from .text import is_blank, norm, number, parse_date, strip, text, to_number

OPS = (
    "is_blank", "not_blank", "is_null", "not_null", "duplicated", "lookup_missing", "numeric_invalid", "date_invalid", "equals", "not_equals",
    "contains", "not_contains", "regex_match", "regex_not_match", "in", "not_in", "gt", "gte", "lt", "lte",
)


@dataclass(frozen=True)
class Condition:
    """``negate`` applies after evaluation: a value that can't be compared fails the test, so negation keeps its row."""

    field: str
    op: str
    value: object = None
    values: Sequence = field(default_factory=tuple)
    case_sensitive: bool = False
    negate: bool = False


def condition(c: Condition, columns: Sequence[str], numbers: str = "plain") -> Column:
    """Compile; unknown fields and operators are errors at analysis time.

    ``duplicated`` is a window by value here, which puts a hot value into one task; ``filter_rows``, ``apply_rules`` and
    ``with_repeats`` count and join instead.
    """
    if c.field not in columns:
        raise ValueError(f"unknown field {c.field!r}; there are {list(columns)}")
    if c.op not in OPS:
        raise ValueError(f"unknown operator {c.op!r}")
    col, fold = F.col(f"`{c.field}`"), lambda v: str(v).strip() if c.case_sensitive else str(v).strip().lower()
    shown = norm(col, c.case_sensitive)
    compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    if c.op in compare:
        found = compare[c.op](number(col, numbers), F.lit(float(c.value)))
    elif c.op in ("regex_match", "regex_not_match"):
        hit = shown.rlike(f"^(?:{c.value})")
        found = hit if c.op == "regex_match" else ~is_blank(col) & ~hit
    else:
        found = {
            "is_blank": lambda: is_blank(col),
            "not_blank": lambda: ~is_blank(col),
            "is_null": col.isNull,
            "not_null": col.isNotNull,
            "duplicated": lambda: F.count(F.lit(1)).over(Window.partitionBy(col)) > 1,
            "lookup_missing": lambda: ~F.coalesce(col.cast("boolean"), F.lit(False)),
            "numeric_invalid": lambda: ~is_blank(col) & to_number(col).isNull(),
            "date_invalid": lambda: ~is_blank(col) & parse_date(col).isNull(),
            "equals": lambda: shown == fold(c.value),
            "not_equals": lambda: shown != fold(c.value),
            "contains": lambda: shown.contains(fold(c.value)),
            "not_contains": lambda: ~shown.contains(fold(c.value)),
            "in": lambda: shown.isin([fold(v) for v in c.values]),
            "not_in": lambda: ~shown.isin([fold(v) for v in c.values]),
        }[c.op]()
    found = F.coalesce(found, F.lit(False))
    return ~found if c.negate else found


def all_of(conditions: Sequence[Condition], columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [condition(c, columns) for c in conditions], F.lit(True))


def any_of(conditions: Sequence[Condition], columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [condition(c, columns) for c in conditions], F.lit(False))


def filter_rows(df: DataFrame, *conditions: Condition, exclude: bool = False) -> DataFrame:
    """Rows that meet all conditions, or with ``exclude`` those that don't."""
    marked, conditions = with_repeats(df, conditions)
    test = all_of(conditions, marked.columns)
    return marked.where(~test if exclude else test).select(*[f"`{c}`" for c in df.columns])


def with_repeats(df: DataFrame, conditions: Sequence[Condition]) -> tuple[DataFrame, list[Condition]]:
    """``duplicated`` conditions as tests of columns that ``mark_repeats`` or ``mark_many`` has added; all others stay."""
    fields = list(dict.fromkeys(c.field for c in conditions if c.op == "duplicated"))
    if unknown := [f for f in fields if f not in df.columns]:
        raise ValueError(f"unknown field {unknown[0]!r}; there are {df.columns}")
    keys = {f"_repeats_{f}": row_cells(df, [f]) for f in fields}
    if len(keys) == 1:
        (output, cells), = keys.items()
        df = mark_repeats(df, cells, output)
    elif keys:
        df = mark_many(df, keys)
    return df, [Condition(f"_repeats_{c.field}", "equals", "true", negate=c.negate) if c.op == "duplicated" else c for c in conditions]


#: What the first cell of a total row says, in full, and the words that begin a remark row.
TOTAL_WORDS = r"(?i)^(total|subtotal|summary|sum|合计|总计|小计|汇总)$"
REMARK_WORDS = r"(?i)^(note|notes|remark|remarks|备注|说明|注释)(?![a-z])"


def _cells(columns: Sequence[str]) -> list[Column]:
    """The stripped cells of a row, null where blank."""
    return [F.nullif(strip(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]


def first_cell(columns: Sequence[str]) -> Column:
    """The first cell that isn't blank, or null. Cells after it are not looked at."""
    return F.coalesce(*_cells(columns)) if columns else F.lit(None).cast("string")


def all_blank(columns: Sequence[str]) -> Column:
    return first_cell(columns).isNull()


def repeated_header(columns: Sequence[str], share: float = 0.6) -> Column:
    """At least two cells, and ``share`` of all, equal the column's own name."""
    same = sum((F.when(F.lower(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))) == c.strip().lower(), 1).otherwise(0) for c in columns), F.lit(0))
    return same >= max(2, -(-int(share * 100) * len(columns) // 100))


def total_row(columns: Sequence[str]) -> Column:
    return F.coalesce(first_cell(columns).rlike(TOTAL_WORDS), F.lit(False))


def remark_row(columns: Sequence[str]) -> Column:
    return F.coalesce(first_cell(columns).rlike(REMARK_WORDS), F.lit(False))


def sparse_note_row(columns: Sequence[str]) -> Column:
    """One cell of eight characters or more in a table of three columns or more, and no total or remark."""
    if len(columns) < 3:
        return F.lit(False)
    first = first_cell(columns)
    # the last cell that isn't blank is only looked for where the first one is long enough
    places = lambda order: F.coalesce(*[F.when(x.isNotNull(), i) for i, x in order])
    cells = list(enumerate(_cells(columns)))
    only = places(cells) == places(cells[::-1])
    return F.when(F.length(first) >= 8, only & ~total_row(columns) & ~remark_row(columns)).otherwise(F.lit(False))


def non_record_row(columns: Sequence[str]) -> Column:
    """Blank rows, repeated headers and totals: rows that no summary should count."""
    return all_blank(columns) | repeated_header(columns) | total_row(columns)
