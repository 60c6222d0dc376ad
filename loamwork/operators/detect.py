"""Detectors of dirty data, safe fixes with their audit, and the quality score.

Row-local detectors are expressions that fill one ``findings`` array in a single scan; what needs the whole table (which
columns hold numbers, quartiles, repeated keys) comes from one aggregate before. Every row is flagged; only samples are
limited.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import all_blank, remark_row, repeated_header, sparse_note_row, total_row
from ..functions.repeats import mark_many, row_cells
from ..functions.text import NUMERIC_TYPES, ZERO_WIDTH, holds_dates, is_amount_name, is_blank, is_count_name, is_key_name, normalize_width, parse_date, strip, typed_number
from ..sources.scratch import written
from .reshape import numbered_names, repeated_names
from .rows import ROW_ID
from .segments import exact_quantiles

FINDINGS = "findings"
FINDING = "array<struct<field:string,issue:string,severity:string,affects_final:boolean,fixable:boolean>>"
#: Issue -> (severity, affects final, fixable, category, action).
VOCABULARY = {
    "empty_table": ("warn", False, False, "structure", "check the source"),
    "all_empty_row": ("warn", False, False, "structure", "remove"),
    "duplicate_row": ("warn", True, False, "duplicate", "review"),
    "duplicate_columns": ("error", True, False, "structure", "rename"),
    "unnamed_column": ("error", True, False, "structure", "rename"),
    "repeated_header_row": ("warn", True, False, "structure", "remove"),
    "summary_row": ("warn", True, False, "structure", "remove"),
    "comment_row": ("warn", True, False, "structure", "remove"),
    "possible_note_row": ("info", False, False, "structure", "review"),
    "null_value": ("error", True, False, "missing", "fill"),
    "empty_string": ("warn", True, False, "missing", "fill"),
    "outer_spaces": ("warn", False, True, "format", "fix"),
    "invisible_characters": ("warn", False, True, "format", "fix"),
    "full_width_characters": ("warn", False, True, "format", "fix"),
    "date_parse_failed": ("error", True, False, "date", "correct"),
    "mixed_date_formats": ("warn", False, False, "date", "unify"),
    "mixed_case_duplicates": ("warn", False, False, "format", "unify"),
    "number_as_text": ("warn", False, False, "format", "convert"),
    "negative_amount": ("error", True, False, "negative", "review"),
    "negative_numeric_value": ("error", True, False, "negative", "review"),
    "outlier": ("warn", False, False, "outlier", "review"),
    "duplicate_key": ("warn", True, False, "duplicate", "review"),
}

#: Issues that need to know of the whole table first.
FROM_FACTS = {"mixed_date_formats", "number_as_text", "negative_amount", "negative_numeric_value", "outlier"}
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def finding(field: str, issue: str) -> Column:
    severity, final, fixable, _, _ = VOCABULARY[issue]
    return F.struct(F.lit(field).alias("field"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(final).alias("affects_final"), F.lit(fixable).alias("fixable"))


def column_name_findings(names: Sequence[str]) -> list[tuple[str, str]]:
    """(field, issue) for repeated, blank and unnamed column names."""
    return [(n, "duplicate_columns") for n in repeated_names(names)] + [(n, "unnamed_column") for n in names if not n.strip() or n.lower().startswith("unnamed:")]


def _facts(df: DataFrame, names: Sequence[str], approx: bool) -> Mapping:
    """One aggregate over all columns: what the value detectors need to know of the whole table."""
    kinds, aggs, exact = dict(df.dtypes), [], {}
    for i, n in enumerate(names):
        c, is_text = F.col(f"`{n}`"), kinds[n] == "string"
        x = typed_number(c, kinds[n])
        if is_text and not holds_dates(n):
            aggs.append(F.count(F.when(~is_blank(c), 1)).alias(f"filled{i}"))
        if is_text and holds_dates(n):
            shape = F.regexp_replace(strip(c), r"\d+", "0")
            aggs.append((F.min(shape) != F.max(shape)).alias(f"shapes{i}"))
        if is_text or kinds[n].startswith(NUMERIC_TYPES):
            aggs += [F.count(x).alias(f"numbers{i}"), F.max(x).alias(f"max{i}")]
            if not is_key_name(n) and (not is_text or is_amount_name(n) or is_count_name(n)):
                if approx:
                    aggs.append(F.percentile_approx(x, [0.25, 0.75], 10_000).alias(f"quartiles{i}"))
                else:
                    exact[f"quartiles{i}"] = x
    facts = df.agg(*aggs).first().asDict() if aggs else {}
    return facts | {k: v for k, v in exact_quantiles(df, exact, [0.25, 0.75]).items() if v[0] is not None}


def _mixed_cases(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """(place, low): lower-cased values that occur in several spellings, written, and the columns that have any.

    All columns share one shuffle; a value counts once for each task, whatever its number of rows.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("place"), strip(F.col(f"`{n}`")).alias("v")) for i, n in enumerate(names)])
    spellings = df.select(F.inline(cells)).where("v <> ''").select("place", F.lower("v").alias("low"), "v").distinct()
    mixed = written(spellings.groupBy("place", "low").count().where("count > 1").select("place", "low"), "mixed-cases")
    return mixed, [r[0] for r in mixed.select("place").distinct().collect()]


def detect(df: DataFrame, row_issues: bool = True, approx: bool = False, keys: Sequence[str] | None = None, issues: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``findings``: all issues of the row and of its cells. Repeated column names are numbered first.

    ``keys``: columns checked for repeated values (key-like ones by default). ``issues``: those looked for (all by default);
    what only others need is not computed. ``approx`` uses sketched quartiles. Repeated
    keys, repeated rows and mixed spellings are found together in one narrow shuffle (``mark_many``), never by a window over
    all rows of a value, and compared by two 64-bit hashes.
    """
    df = df.toDF(*numbered_names(df.columns)) if len(set(df.columns)) < len(df.columns) else df
    names = [c for c in df.columns if c not in (ROW_ID, FINDINGS)]
    wanted = set(VOCABULARY if issues is None else issues)
    if unknown := wanted - set(VOCABULARY):
        raise ValueError(f"no such issues: {sorted(unknown)}")
    columns, kinds, facts, found = df.columns, dict(df.dtypes), _facts(df, names, approx) if wanted & FROM_FACTS else {}, []
    plain_texts = [n for n in names if kinds[n] == "string" and not holds_dates(n)]
    mixed, mixed_at = _mixed_cases(df, plain_texts) if plain_texts and "mixed_case_duplicates" in wanted else (None, [])
    key_names = ([n for n in names if is_key_name(n)] if keys is None else list(keys)) if "duplicate_key" in wanted else []
    plain = lambda n: F.col(f"`{n}`") if kinds[n] in WHOLE_NUMBERS else strip(F.col(f"`{n}`").cast("string"))
    repeats = {f"_key_again{i}": [plain(n)] for i, n in enumerate(key_names)}
    row_again = row_issues and "duplicate_row" in wanted
    if row_again:
        repeats["_row_again"] = row_cells(df, names)
    df = mark_many(df, repeats, {f"_mixed{i}": (F.lower(strip(F.col(f"`{plain_texts[i]}`"))), mixed.where(F.col("place") == i).select("low")) for i in mixed_at})
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        x, is_text = typed_number(c, kinds[n]), kinds[n] == "string"

        def when(test: Column, issue: str, field: str = n) -> None:
            if issue in wanted:
                found.append(F.when(F.coalesce(test, F.lit(False)), finding(field, issue)))

        when(c.isNull(), "null_value")
        if is_text:
            when(strip(c) == "", "empty_string")
            when((c != strip(c)) & (strip(c) != ""), "outer_spaces")
            when(c.rlike(ZERO_WIDTH), "invisible_characters")
            when(c.rlike(r"[\x{3000}\x{FF01}-\x{FF5E}]"), "full_width_characters")
        if is_text and holds_dates(n):
            when(~is_blank(c) & parse_date(c).isNull(), "date_parse_failed")
            if facts.get(f"shapes{i}"):
                when(~is_blank(c), "mixed_date_formats")
        elif is_text:
            if facts.get(f"filled{i}") and facts[f"numbers{i}"] >= 0.8 * facts[f"filled{i}"]:
                when(~is_blank(c), "number_as_text")
            if (at := plain_texts.index(n)) in mixed_at:
                when(F.col(f"_mixed{at}"), "mixed_case_duplicates")
        if (is_amount_name(n) or is_count_name(n)) and (facts.get(f"max{i}") or 0) > 0:
            when(x < 0, "negative_amount" if is_amount_name(n) else "negative_numeric_value")
        quartiles = facts.get(f"quartiles{i}")
        if quartiles and facts[f"numbers{i}"] >= 4 and quartiles[1] > quartiles[0]:
            reach = 1.5 * (quartiles[1] - quartiles[0])
            when((x < quartiles[0] - reach) | (x > quartiles[1] + reach), "outlier")
    if row_issues:
        for test, issue in ((all_blank, "all_empty_row"), (repeated_header, "repeated_header_row"), (total_row, "summary_row"), (remark_row, "comment_row"), (sparse_note_row, "possible_note_row")):
            if issue in wanted:
                found.append(F.when(test(names), finding("", issue)))
    if row_again:
        found.append(F.when(F.col("_row_again"), finding("", "duplicate_row")))
    for i, n in enumerate(key_names):
        found.append(F.when((F.col(f"`{n}`").isNotNull() if kinds[n] in WHOLE_NUMBERS else plain(n) != "") & F.col(f"_key_again{i}"), finding(n, "duplicate_key")))
    shown = [F.col(f"`{c}`") for c in columns if c != FINDINGS]
    return df.select(*shown, (F.array_compact(F.array(*found)) if found else F.array()).cast(FINDING).alias(FINDINGS))


def issue_summary(detected: DataFrame, table: str = "table", columns: Sequence[str] | None = None) -> DataFrame:
    """(table, field, issue, severity, affected_rows, ...), most severe and frequent first.

    An empty table is an issue of its own (with no rows affected), and so are repeated and unnamed names among ``columns``
    (by default those of ``detected``), each with the number of columns it concerns.
    """
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    keys = ("field", "issue", "severity", "affects_final", "fixable")
    row = F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, ("", "", "", False, False))])  # one for each row, so that rows are counted with the findings
    counts = detected.select(F.inline(F.concat(FINDINGS, F.array(row)))).groupBy(*keys).agg(F.count(F.lit(1)).alias("affected_rows"))
    each = counts.where("issue <> ''")
    empty = counts.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(finding("", "empty_table").alias("f")).select("f.*", F.lit(0).cast("long").alias("affected_rows"))
    shown = [c for c in (columns if columns is not None else detected.columns) if c not in (ROW_ID, FINDINGS)]
    if names := column_name_findings(shown):
        counted = F.array(*[F.struct(finding(*x).alias("f"), F.lit(shown.count(x[0])).cast("long").alias("affected_rows")) for x in dict.fromkeys(names)])
        empty = empty.union(detected.sparkSession.range(1, numPartitions=1).select(F.inline(counted)).select("f.*", "affected_rows"))
    each = each.union(empty)
    return each.select(F.lit(table).alias("table"), "*").orderBy(order, F.col("affected_rows").desc(), "field", "issue")


def record_issues(detected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each finding, with the keys of its row."""
    return detected.select(*keys, F.inline(FINDINGS))


def critical_row() -> Column:
    return F.exists(FINDINGS, lambda x: x["affects_final"] | (x["severity"] == "error"))


def as_issues() -> Column:
    """Findings in the form of rule issues, so that both decide together about a row."""
    category = F.create_map(*[F.lit(v) for k, x in VOCABULARY.items() for v in (k, x[3])])
    return F.transform(FINDINGS, lambda x: F.struct(F.concat(F.lit("dirty:"), x["field"], F.lit(":"), x["issue"]).alias("reason"), x["field"].alias("field"), F.when(x["affects_final"], F.lit("error")).otherwise(x["severity"]).alias("severity"), category[x["issue"]].alias("kind")))


def taxonomy(spark) -> DataFrame:
    rows = [(k, *v) for k, v in VOCABULARY.items()]
    return spark.createDataFrame(rows, "issue string, severity string, affects_final boolean, fixable boolean, category string, action string")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def auto_fix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text with zero-width characters removed, full-width forms folded and outer spaces stripped. Applying it twice changes nothing."""
    chosen = set(columns if columns is not None else text_columns(df))
    return df.select(*[normalize_width(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def fix_audit(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(keys, field, before, after) for each cell that ``auto_fix`` changes. One scan, no join."""
    chosen = list(columns if columns is not None else text_columns(df))
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("before"), normalize_width(F.col(f"`{c}`")).alias("after")) for c in chosen])
    return df.select(*keys, F.inline(F.filter(cells, lambda x: x["before"] != x["after"])))


#: Most points that each ground can take off the score of 100.
DEDUCTIONS = {"unmet_work": 40, "exceptions": 25, "critical_issues": 12, "dirty_errors": 12, "dirty_warnings": 6, "join_expansion": 5}


def quality_score(spark, rows: int, exceptions: int, critical_types: int, dirty_errors: int, dirty_warnings: int, expansions: int = 0, unmet: int = 0, asked: int = 0, grace: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(score, deductions): 100 less what each ground takes off, each up to its limit."""
    share = lambda n: n / rows if rows else 0.0
    raw = {
        "unmet_work": 40 * unmet / asked if asked else 0.0,
        "exceptions": max(0.0, share(exceptions) - grace) * 100,
        "critical_issues": critical_types * 3.0,
        "dirty_errors": share(dirty_errors) * 35,
        "dirty_warnings": share(dirty_warnings) * 12,
        "join_expansion": expansions * 5.0,
    }
    taken = [(k, round(min(v, DEDUCTIONS[k]), 2), DEDUCTIONS[k]) for k, v in raw.items()]
    score = max(0.0, round(100 - sum(t[1] for t in taken), 2))
    return spark.createDataFrame([(score, rows)], "score double, rows long"), spark.createDataFrame(taken, "ground string, points double, most int")


def exception_impact(rule_issues: DataFrame, detected: DataFrame) -> DataFrame:
    """(source, reason, affected_rows, affects_final, auto_fixed, needs_confirmation) of rules and detectors together."""
    rules = rule_issues.select(F.inline("issues")).groupBy("reason", "severity").agg(F.count(F.lit(1)).alias("affected_rows"))
    rules = rules.select(F.lit("rule").alias("source"), "reason", "affected_rows", (F.col("severity") == "error").alias("affects_final"), F.lit(False).alias("auto_fixed"), (F.col("severity") != "error").alias("needs_confirmation"))
    dirty = detected.select(F.inline(FINDINGS)).groupBy("field", "issue", "affects_final", "fixable").agg(F.count(F.lit(1)).alias("affected_rows"))
    dirty = dirty.select(F.lit("detector").alias("source"), F.concat_ws(":", "field", "issue").alias("reason"), "affected_rows", "affects_final", F.col("fixable").alias("auto_fixed"), (~F.col("affects_final") & ~F.col("fixable")).alias("needs_confirmation"))
    return rules.unionByName(dirty).orderBy(F.col("affects_final").desc(), F.col("affected_rows").desc(), "source", "reason")


def any_finding(*issues: str) -> Column:
    return F.exists(FINDINGS, lambda x: x["issue"].isin(list(issues)))
