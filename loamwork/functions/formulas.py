"""Row formulas, spreadsheet style: each compiles to one Column."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import Condition, all_of, any_of, condition
from .text import is_blank, normalize_width, parse_date, strip, text, to_number

#: What spreadsheets write for a failed cell, and what counts as true.
ERROR_TOKENS = ["#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!"]
TRUTHY = ["true", "1", "yes", "y", "是", "对"]


@dataclass(frozen=True)
class Formula:
    output: str
    op: str
    source: str | None = None
    columns: Sequence[str] = ()
    value: object = None
    values: Sequence = ()
    mapping: Mapping = field(default_factory=dict)
    default: object = None
    sep: str = ""
    conditions: Sequence[Condition] = ()
    true_value: object = True
    false_value: object = False
    required: bool = True


def _pattern(p: str) -> str:
    """A spreadsheet date format, or one with %Y %y %m %d, as a Spark pattern. ``mm`` is a month, after hours minutes."""
    known = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "yyyy": "yyyy", "yy": "yy", "mm": "MM", "dd": "dd"}

    def token(m: re.Match) -> str:
        t = m[0]
        if t in known or t.lower() in known:
            return known.get(t) or known[t.lower()]
        return t if re.match(r"[hH]{1,2}:", t) else "'" + t.replace("'", "''") + "'"

    return re.sub(r"%[Yymd]|[hH]{1,2}:mm(?::ss)?|[yY]{4}|[yY]{2}|[mM]{2}|[dD]{2}|(?:(?!%[Yymd]|[yY]{2}|[mM]{2}|[dD]{2})[A-Za-z'])+", token, p)


def _away(x: Column, digits: int, up: bool) -> Column:
    scale = 10.0**digits
    whole = F.ceil(F.abs(x) * scale) if up else F.floor(F.abs(x) * scale)
    return F.signum(x) * whole / F.lit(scale)


def formula(f: Formula, columns: Sequence[str]) -> Column:
    """The column of a row-local formula. Unknown columns or operators are errors at analysis time."""
    for name in [n for n in [f.source, *f.columns] if n is not None]:
        if name not in columns:
            raise ValueError(f"{f.op}: unknown column {name!r}")
    c = F.col(f"`{f.source}`") if f.source is not None else None
    s = text(c) if c is not None else None
    cs = [F.col(f"`{n}`") for n in f.columns]
    default, digits = F.lit(f.default), int(f.value) if f.op in ("round", "roundup", "rounddown") and f.value is not None else 0

    def arithmetic(join):
        if len(cs) != 2:
            raise ValueError(f"{f.op} takes two columns")
        return join(to_number(cs[0]), to_number(cs[1]))

    def split_part():
        if not f.sep:
            raise ValueError("split needs a separator")
        part = F.get(F.split(s, "\\Q" + f.sep + "\\E"), F.lit(int(f.value or 0)))
        return F.coalesce(part, F.lit(f.default if f.default is not None else ""))

    def choose():
        out = None
        for test, v in zip(f.conditions, f.values):
            test = condition(test, columns)
            out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
        return out.otherwise(default) if out is not None else default

    def bucket():
        x, out = to_number(c), None
        for limit in sorted(f.values):
            name = F.lit(str(f.mapping.get(limit, f.mapping.get(str(limit), limit))))
            out = F.when(x <= float(limit), name) if out is None else out.when(x <= float(limit), name)
        return out.otherwise(default)

    def mapped():
        pairs = [F.lit(str(x)) for kv in f.mapping.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), c.cast("string")), default)

    def made_date():
        if len(cs) == 3:
            y, m, d = (F.coalesce(to_number(x), F.lit(0)).cast("int") for x in cs)
            return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0))
        return parse_date(c)

    def difference():
        start, end = parse_date(c), parse_date(cs[0]) if cs else F.lit(str(f.value)).cast("timestamp")
        unit = str((f.value if cs else f.default) or "days")
        micros = (F.unix_micros(end) - F.unix_micros(start)).cast("double")
        return {"days": F.floor(micros / 8.64e10).cast("double"), "hours": micros / 3.6e9, "minutes": micros / 6e7}[unit]

    def shown():
        pattern = str(f.value)
        if re.search("[yYmMdD]", pattern):
            return F.date_format(parse_date(c), _pattern(pattern))
        places = len(pattern.partition(".")[2].rstrip("%"))
        x = to_number(c) * (100 if pattern.endswith("%") else 1)
        shown_ = F.format_number(x, places) if "," in pattern else F.format_string(f"%.{places}f", x)
        return F.concat(shown_, F.lit("%")) if pattern.endswith("%") else shown_

    ops = {
        "copy": lambda: c,
        "literal": lambda: F.lit(f.value),
        "trim": lambda: strip(s),
        "upper": lambda: F.upper(s),
        "lower": lambda: F.lower(s),
        "concat": lambda: F.concat_ws(f.sep, *map(text, cs)),
        "join": lambda: F.concat_ws(f.sep, *map(text, cs)),
        "textjoin": lambda: F.array_join(F.filter(F.array(*map(text, cs)), lambda x: (x != "") if f.value in (None, True) else F.lit(True)), f.sep),
        "coalesce": lambda: F.coalesce(*[F.when(~is_blank(x), x) for x in cs], default),
        "map": mapped,
        "if_else": lambda: F.when(all_of(f.conditions, columns), F.lit(f.true_value)).otherwise(F.lit(f.false_value)),
        "ifs": choose,
        "and": lambda: all_of(f.conditions, columns) if f.conditions else F.lower(strip(s)).isin(TRUTHY),
        "or": lambda: any_of(f.conditions, columns) if f.conditions else F.lower(strip(s)).isin(TRUTHY),
        "not": lambda: ~(all_of(f.conditions, columns) if f.conditions else F.lower(strip(s)).isin(TRUTHY)),
        "add": lambda: arithmetic(lambda a, b: a + b),
        "subtract": lambda: arithmetic(lambda a, b: a - b),
        "multiply": lambda: arithmetic(lambda a, b: a * b),
        "divide": lambda: arithmetic(F.try_divide),
        "is_blank": lambda: is_blank(c),
        "equals": lambda: F.coalesce(strip(s) == str(f.value).strip(), F.lit(False)),
        "isin": lambda: s.isin([str(v) for v in f.values]),
        "contains": lambda: s.rlike(str(f.value)),
        "iferror": lambda: F.when(c.isNull() | s.isin(ERROR_TOKENS) | s.isin("Infinity", "-Infinity", "NaN"), default).otherwise(c),
        "ifna": lambda: F.when(c.isNull() | (s == "#N/A"), default).otherwise(c),
        "left": lambda: F.substring(s, 1, int(f.value)),
        "right": lambda: F.right(s, F.lit(int(f.value))) if int(f.value) else s,
        "mid": lambda: F.substring(s, int(f.values[0]), int(f.values[1])),
        "len": lambda: F.length(s),
        "substitute": lambda: F.replace(s, F.lit(str(f.values[0])), F.lit(str(f.values[1]))),
        "replace": lambda: F.concat(F.substring(s, 1, int(f.values[0]) - 1), F.lit(str(f.value or "")), F.substring(s, int(f.values[0]) + int(f.values[1]), 1 << 30)),
        "text": shown,
        "date": made_date,
        "year": lambda: F.year(parse_date(c)),
        "month": lambda: F.month(parse_date(c)),
        "day": lambda: F.day(parse_date(c)),
        "today": lambda: F.lit(str(f.value)).cast("date").cast("timestamp") if f.value else F.current_date().cast("timestamp"),
        "now": lambda: F.lit(str(f.value)).cast("timestamp") if f.value else F.current_timestamp(),
        "date_diff": difference,
        "round": lambda: F.bround(to_number(c), digits),
        "roundup": lambda: _away(to_number(c), digits, True),
        "rounddown": lambda: _away(to_number(c), digits, False),
        "abs": lambda: F.abs(to_number(c)),
        "bucket": bucket,
        "regex_extract": lambda: F.when(s.rlike(str(f.value)), F.regexp_extract(s, str(f.value), int(f.values[0] if f.values else 0) + 1)).otherwise(F.lit(f.default if f.default is not None else "")),
        "regex_replace": lambda: F.regexp_replace(s, str(f.value), str(f.default or "")),
        "split": split_part,
        "remove_special_chars": lambda: F.regexp_replace(s, str(f.value or r"[^0-9A-Za-z\x{4E00}-\x{9FFF}]"), str(f.default or "")),
        "normalize_width": lambda: normalize_width(s),
    }
    if f.op not in ops:
        raise ValueError(f"unknown formula operator {f.op!r}")
    return ops[f.op]()
