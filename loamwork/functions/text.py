"""Text, number and date primitives that everything else is built on. Columns in, columns out; no Python runs on rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import nfkc

#: Full-width forms U+FF01..U+FF5E and the ideographic space, with their ASCII forms.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
ZERO_WIDTH = "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: The English names of months, of which three letters or all may be written.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_TIME = r"(?:[ T]\d{1,2}:\d\d(?::\d\d(?:\.\d{1,9})?)?)"
_ZONE = r"(?: ?(?:Z|[+-]\d\d(?::?\d\d)?))"
#: The shapes of dates that are understood, each with what turns its parts into ISO 8601; years have four digits.
#: No text has two shapes.
DATE_SHAPES = {
    "ISO 8601, also with / or . and short parts, or without a day": (rf"^(\d{{4}})([-/.])(\d{{1,2}})(?:\2(\d{{1,2}})({_TIME}{_ZONE}?)?)?$", None),
    "20240305, 20240305T101112Z": (r"^(\d{4})(\d\d)(\d\d)(?:[T ]?(\d\d)(\d\d)(\d\d)(Z?))?$", None),
    "2024年3月5日": (rf"^(\d{{4}})年(\d{{1,2}})月(?:(\d{{1,2}})日({_TIME}{_ZONE}?)?)?$", None),
    "month/day/year": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})({_TIME}{_ZONE}?)?$", "$3-$1-$2$4"),
    "Mar 5, 2024 or March 2024": (rf"(?i)^([a-z]{{3,9}})\.? (?:(\d{{1,2}}),? )?(\d{{4}})({_TIME}{_ZONE}?)?$", "$3-#$1-$2$4"),
    "5 Mar 2024, 5-Mar-2024": (rf"(?i)^(\d{{1,2}})[ -]([a-z]{{3,9}})\.?,?[ -](\d{{4}})({_TIME}{_ZONE}?)?$", "$3-#$2-$1$4"),
}
#: All characters with Unicode's White_Space property.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def text(c: Column) -> Column:
    """As string, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` only removes U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once a row, however often ``f`` uses it (Spark shares nothing between CASE branches)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space. Never null itself."""
    return c.isNull() | (strip(c.cast("string")) == "")


def norm(c: Column, case_sensitive: bool = False) -> Column:
    """The form in which text is compared: null as empty, stripped, lower case."""
    s = strip(text(c))
    return s if case_sensitive else F.lower(s)


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def normalize_width(c: Column) -> Column:
    """Zero-width characters removed, full-width forms folded, stripped."""
    return strip(half_width(F.regexp_replace(c, ZERO_WIDTH, "")))


def normalize_key(c: Column) -> Column:
    """A key for matching across tables: compatibility forms folded (NFKC), stripped, lower case."""
    return F.lower(strip(nfkc(c.cast("string"))))


def to_number(c: Column) -> Column:
    """A plain number as double, else null ('1d', 'NaN' and 'Infinity' are not numbers here)."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def parse_business_number(c: Column) -> Column:
    """Numbers as people write them: 1,234 · (567) · ¥(567.00) · 1.2万 · 85% · 100块 · full-width digits. Else null.

    A percent sign is dropped, not divided by. 万, 亿, 千, 百万 and k multiply. Accounting brackets negate.
    """
    def bare(s: Column) -> Column:
        return F.regexp_replace(half_width(s), r"[,\s¥￥$€£元圆块]|人民币|美元|(?i:rmb|cny|usd)", "")

    def scaled(s: Column) -> Column:
        scale = (
            F.when(s.endswith("百万"), 1e6).when(s.endswith("万"), 1e4).when(s.endswith("亿"), 1e8)
            .when(s.endswith("千"), 1e3).when(F.lower(s).endswith("k"), 1e3).otherwise(1.0)
        )
        return to_number(F.regexp_replace(s, r"(百万|万|亿|千|[kK])$", "")) * scale

    def signed(s: Column) -> Column:
        inside = F.regexp_replace(F.regexp_replace(s, r"^\((.+)\)$", "$1"), r"%$", "")
        return F.when(s.startswith("("), -1.0).otherwise(1.0) * once(inside, scaled)

    # most cells are plain numbers or blank: those take one pattern and nothing else
    return once(strip(c.cast("string")), lambda s: F.when(s.rlike(_NUMBER), s.try_cast("double")).when(s.rlike(r"\p{Nd}"), once(bare(s), signed)))


def typed_number(c: Column, kind: str) -> Column:
    """``to_number`` for a column of Spark type ``kind``: numeric types are only cast, dates and booleans hold no numbers."""
    if kind.startswith(NUMERIC_TYPES):
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) if kind in ("float", "double") else x
    return to_number(c) if kind.startswith(("string", "char", "varchar")) else F.lit(None).cast("double")


def number(c: Column, numbers: str = "plain") -> Column:
    """``plain`` or ``business`` reading; numeric columns pass through either unchanged in value."""
    if numbers not in ("plain", "business"):
        raise ValueError("numbers must be 'plain' or 'business'")
    return parse_business_number(c) if numbers == "business" else to_number(c)


def parse_date(c: Column) -> Column:
    """A date or time in any of ``DATE_SHAPES``, as timestamp; else null. Texts without an offset are in the session's zone.

    The characters a text begins with and holds tell its shape, so one pattern is tried for each text, and Spark's own
    reading of ISO 8601 does the rest.
    """
    iso, compact, cjk, us, month_first, day_first = DATE_SHAPES.values()
    stamp = lambda x: x.try_cast("timestamp")

    def named(s: Column, shape: tuple[str, str]) -> Column:
        """Year-#name-day to ISO; an unknown name leaves a text that is no date, a missing day is the first."""
        parts = F.regexp_replace(s, *shape)
        name = F.lower(F.regexp_extract(parts, "#([A-Za-z]+)", 1))
        known = {k: i for i, m in enumerate(MONTHS, 1) for k in (m[:3], m)} | {"sept": 9}
        number = F.create_map(*[F.lit(x) for k, i in known.items() for x in (k, f"{i:02d}")])
        return F.when(s.rlike(shape[0]), stamp(F.regexp_replace(F.regexp_replace(parts, "#[A-Za-z]+", F.element_at(number, name)), "-(?=[ T]|$)", "-1")))

    def read(s: Column) -> Column:
        return (
            F.when(~s.rlike(r"\d{4}"), F.lit(None).cast("timestamp"))
            .when(s.rlike("^[A-Za-z]"), named(s, month_first))
            .when(s.rlike(r"^\d{4}[-/.]"), F.when(s.rlike(iso[0]), stamp(F.regexp_replace(F.regexp_replace(s, r"^(\d{4})[-/.](\d{1,2})(?:[-/.]|$)", "$1-$2-"), "-$", "-1"))))
            .when(s.rlike(r"^\d{4}年"), F.when(s.rlike(cjk[0]), stamp(F.regexp_replace(F.regexp_replace(s, "^(.{4})年(.+?)月(.*?)日?(?=[ T]|$)", "$1-$2-$3"), "-$", "-1"))))
            .when(s.rlike(r"^\d{8}"), F.when(s.rlike(compact[0]), stamp(F.regexp_replace(F.regexp_replace(s, compact[0], "$1-$2-$3T$4:$5:$6$7"), "T::$", ""))))
            .when(s.rlike(r"^\d{1,2}/"), F.when(s.rlike(us[0]), stamp(F.regexp_replace(s, *us))))
            .otherwise(named(s, day_first))
        )

    return once(strip(c.cast("string")), read)


def time_bucket(c: Column, unit: str, missing: str = "(no date)") -> Column:
    """2024-03 (month), 2024-Q1 (quarter), 2024 (year) or 2024-W09 (ISO week); ``missing`` where there is no date."""
    labels = {
        "month": F.date_format(c, "yyyy-MM"),
        "quarter": F.concat(F.date_format(c, "yyyy"), F.lit("-Q"), F.quarter(c).cast("string")),
        "year": F.date_format(c, "yyyy"),
        "week": F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0")),
    }
    if unit not in labels:
        raise ValueError(f"unit must be one of {sorted(labels)}")
    return F.coalesce(labels[unit], F.lit(missing))


# Names of columns: driver code on the schema.

#: Parts of column names that mark a role.
KEY_SUFFIXES = ("id", "code", "key", "no", "number", "license", "编号", "编码", "单号", "代码", "号")
KEY_TOKENS = ("sitecode", "guid", "uuid", "编号", "编码", "单号", "工号", "卡号", "主键", "代码", "序号")
DATE_TOKENS = ("date", "time", "day", "month", "year", "日期", "时间", "月份", "年度", "日", "月", "年")
CELL_DATE_TOKENS = ("date", "time", "day", "日期", "时间")
AMOUNT_TOKENS = ("amount", "price", "total", "cost", "fee", "balance", "金额", "费用", "价格", "单价")
COUNT_TOKENS = ("qty", "quantity", "count", "stock", "inventory", "age", "duration", "days", "hours", "数量", "库存", "年龄", "时长", "天数", "小时", "人数", "件数")
SENSITIVE_TOKENS = ("name", "email", "phone", "mobile", "address", "passport", "姓名", "邮箱", "电话", "手机", "地址", "身份证")


def normalize_name(name: str) -> str:
    """Lower case, letters, digits and CJK only: the form in which column names match across tables."""
    return re.sub(r"[^0-9a-z一-鿿]+", "", name.lower())


def is_key_name(name: str) -> bool:
    parts = re.split(r"[^0-9a-z一-鿿]+", name.lower())
    flat = normalize_name(name)
    return any(p in KEY_SUFFIXES for p in parts) or any(t in flat for t in KEY_TOKENS) or flat.endswith(("id", "key", "code", *[k for k in KEY_SUFFIXES if not k.isascii()]))


def is_date_name(name: str) -> bool:
    """A column about time, months and years included."""
    return any(t in name.lower() for t in DATE_TOKENS)


def holds_dates(name: str) -> bool:
    """A column whose cells should be whole dates (a year or month of its own need not be)."""
    return any(t in name.lower() for t in CELL_DATE_TOKENS)


def is_amount_name(name: str) -> bool:
    return any(t in name.lower() for t in AMOUNT_TOKENS)


def is_count_name(name: str) -> bool:
    """Counts, ages and durations: numbers that can't be below zero."""
    parts = re.split(r"[^0-9a-z一-鿿]+", name.lower())
    return any(t in parts if t.isascii() else t in name for t in COUNT_TOKENS)


def is_sensitive_name(name: str) -> bool:
    return any(t in name.lower() for t in SENSITIVE_TOKENS) or is_key_name(name)
