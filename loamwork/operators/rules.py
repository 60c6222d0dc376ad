"""Validation rules: compiled from constraints, applied as an array of issues, and the split they decide."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Condition, condition, with_repeats

ISSUES = "issues"
SEVERITY = {"info": 0, "warn": 1, "error": 2}
EMAIL_PATTERN = r"[^@\s]+@[^@\s]+\.[^@\s]+$"


@dataclass(frozen=True)
class Rule:
    """Rows that meet the condition get ``reason``."""

    name: str
    field: str
    op: str
    value: object = None
    values: tuple = ()
    reason: str = ""
    severity: str = "error"

    def condition(self) -> Condition:
        return Condition(self.field, self.op, self.value, self.values)


def _issue(r: Rule) -> Column:
    kind = "missing" if r.op in ("is_blank", "is_null") else "duplicate" if r.op == "duplicated" else "unmatched_lookup" if r.op == "lookup_missing" else "format" if "regex" in r.op or r.op == "numeric_invalid" else "date" if r.op == "date_invalid" else "value"
    return F.struct(F.lit(r.reason or r.name).alias("reason"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"), F.lit(kind).alias("kind"))


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds to ``issues`` (array of reason, field, severity, kind). No row goes; one expression for all rules."""
    marked, tests = with_repeats(df, [r.condition() for r in rules])
    made = F.array_compact(F.array(*[F.when(condition(t, marked.columns), _issue(r)) for r, t in zip(rules, tests)])) if rules else F.array().cast("array<struct<reason:string,field:string,severity:string,kind:string>>")
    done = marked.withColumn(ISSUES, F.concat(F.col(ISSUES), made) if ISSUES in df.columns else made)
    return done.select(*[f"`{c}`" for c in df.columns if c != ISSUES], ISSUES) if ISSUES not in df.columns else done.select(*[f"`{c}`" for c in df.columns])


def in_scope(kinds: Sequence[str] | None) -> Column:
    """The issues of these kinds; ``None`` means all, an empty list none."""
    return F.col(ISSUES) if kinds is None else F.filter(F.col(ISSUES), lambda x: x["kind"].isin(list(kinds)) if kinds else F.lit(False))


def needs_review(exclude_critical: bool = True, include_minor: bool = True, unmatched_forces_review: bool = True, kinds: Sequence[str] | None = None) -> Column:
    found = in_scope(kinds)
    critical = F.exists(found, lambda x: x["severity"] == "error") if exclude_critical else F.lit(False)
    minor = F.exists(found, lambda x: x["severity"] != "error") if not include_minor else F.lit(False)
    unmatched = F.exists(found, lambda x: x["kind"] == "unmatched_lookup") if unmatched_forces_review else F.lit(False)
    return critical | minor | unmatched


def mark_usable(df: DataFrame, output: str = "part", **policy) -> DataFrame:
    """Adds ``usable`` or ``review``: one scan decides both parts, which a sink can then write by that column."""
    return df.withColumn(output, F.when(needs_review(**policy), "review").otherwise("usable"))


def split_usable(df: DataFrame, **policy) -> tuple[DataFrame, DataFrame]:
    """(usable, review): each row is in one of the two."""
    test = needs_review(**policy)
    return df.where(~test), df.where(test)


def flagged(df: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    return df.where(F.size(in_scope(kinds)) > 0)


def run_counts(df: DataFrame, total: int | None = None, **policy) -> DataFrame:
    """One row: total, output, filtered_out, valid, abnormal."""
    n = F.count(F.lit(1))
    all_ = F.lit(total) if total is not None else n
    return df.agg(all_.cast("long").alias("total"), n.alias("output"), (all_ - n).cast("long").alias("filtered_out"), F.count(F.when(~needs_review(**policy), 1)).alias("valid"), F.count(F.when(needs_review(**policy), 1)).alias("abnormal"))


def issue_text(sep: str = ";") -> Column:
    """The distinct reasons of a row, for sinks without arrays."""
    return F.array_join(F.array_distinct(F.transform(F.col(ISSUES), lambda x: x["reason"])), sep)


def merge_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Rules with the same condition become one; the stronger severity wins."""
    out: dict[tuple, Rule] = {}
    for r in rules:
        key = (r.field, r.op, str(r.value), tuple(map(str, r.values)))
        if key not in out or SEVERITY[r.severity] > SEVERITY[out[key].severity]:
            out[key] = r
    return list(out.values())


def compile_constraints(field: str, required: bool = False, allowed: Sequence = (), least=None, most=None, format: str | None = None, type: str | None = None) -> list[Rule]:
    """Constraints of one field as rules. Blanks and types are errors; ranges, allowed values and formats warn."""
    out = []
    if required:
        out.append(Rule(f"{field} required", field, "is_blank", reason=f"{field}_blank", severity="error"))
    if allowed:
        out.append(Rule(f"{field} allowed values", field, "not_in", values=tuple(allowed), reason=f"{field}_not_allowed", severity="warn"))
    if least is not None:
        out.append(Rule(f"{field} minimum", field, "lt", least, reason=f"{field}_too_small", severity="warn"))
    if most is not None:
        out.append(Rule(f"{field} maximum", field, "gt", most, reason=f"{field}_too_large", severity="warn"))
    if format == "email":
        out.append(Rule(f"{field} e-mail", field, "regex_not_match", EMAIL_PATTERN, reason=f"{field}_bad_email", severity="warn"))
    if type in ("number", "integer", "numeric"):
        out.append(Rule(f"{field} number", field, "numeric_invalid", reason=f"{field}_not_a_number", severity="error"))
    if type in ("date", "datetime") or format in ("date", "date-time"):
        out.append(Rule(f"{field} date", field, "date_invalid", reason=f"{field}_not_a_date", severity="error"))
    return out


def rules_from_json_schema(document: str | Mapping) -> list[Rule]:
    """``properties`` (or ``fields``) with type, enum, minimum, maximum and format, and ``required``."""
    spec = json.loads(document) if isinstance(document, str) else document
    props = spec.get("properties") or {f["name"]: f for f in spec.get("fields", [])}
    required = set(spec.get("required", [])) | {n for n, p in props.items() if p.get("required") is True}
    out = []
    for name, p in props.items():
        out += compile_constraints(name, name in required, p.get("enum") or p.get("allowed") or (), p.get("minimum", p.get("min")), p.get("maximum", p.get("max")), p.get("format"), p.get("type"))
    return merge_rules(out)


#: How rule sentences say what they ask for.
_REQUIRED, _ALLOWED, _LEAST, _MOST, _EMAIL = r"(?i)必填|不能为空|\brequired\b|must not be (?:blank|empty)", r"(?i)(?:允许值|取值|allowed(?: values)?|one of)\s*[:：]?\s*(.+)$", r"(?:>=|≥|不小于|at least)\s*(-?[0-9.]+)", r"(?:<=|≤|不大于|at most)\s*(-?[0-9.]+)", r"(?i)邮箱格式|e-?mail"
RULE_ROWS = "field string, kind string, value string"


def extract_rules(documents: DataFrame, fields: Sequence[str], text_column: str = "text") -> DataFrame:
    """(field, kind, value) for each rule sentence about one of ``fields`` in a table of documents, a sentence a line.

    Markdown table rows are lines too: a cell that is the field's name, and the signals in the rest of the row.
    """
    lines = documents.select(F.explode(F.split(text_column, "\n")).alias("line")).where(F.trim("line") != "")
    names = F.array(*map(F.lit, fields))
    about = lines.withColumn("field", F.explode(F.filter(names, lambda n: F.col("line").contains(n))))
    line = F.col("line")

    def number_after(p: str) -> Column:
        return F.when(line.rlike(p), F.regexp_extract(line, p, 1))

    allowed = F.when(line.rlike(_ALLOWED), F.regexp_replace(F.regexp_extract(line, _ALLOWED, 1), r"\s*[,，、/|]\s*", ","))
    found = F.array(
        F.when(line.rlike(_REQUIRED), F.struct(F.lit("required").alias("kind"), F.lit("").alias("value"))),
        F.when(allowed.isNotNull(), F.struct(F.lit("allowed").alias("kind"), F.trim(allowed).alias("value"))),
        F.when(line.rlike(_LEAST), F.struct(F.lit("min").alias("kind"), number_after(_LEAST).alias("value"))),
        F.when(line.rlike(_MOST), F.struct(F.lit("max").alias("kind"), number_after(_MOST).alias("value"))),
        F.when(line.rlike(_EMAIL), F.struct(F.lit("email").alias("kind"), F.lit("").alias("value"))),
    )
    return about.select("field", F.inline(F.array_compact(found))).dropDuplicates()


def rules_from_rows(rows: Sequence[Mapping]) -> list[Rule]:
    """Extracted rule rows as rules."""
    out = []
    for r in rows:
        k, v = r["kind"], r["value"]
        out += compile_constraints(r["field"], k == "required", tuple(x for x in v.split(",") if x) if k == "allowed" else (), float(v) if k == "min" else None, float(v) if k == "max" else None, "email" if k == "email" else None)
    return merge_rules(out)


#: What the name of an import template holds.
TEMPLATE_TOKENS = ("template", "import", "导入", "模板")


def looks_like_template(name: str) -> bool:
    return any(t in name.lower() for t in TEMPLATE_TOKENS)


def template_requirements(tables: Mapping[str, Sequence[str]], inventory: Sequence[Mapping]) -> list[dict]:
    """(source_file, field) for every column of a table that is an import template, as its own or its file's name says."""
    out = []
    for r in inventory:
        if r["table"] in tables and looks_like_template(f"{r['file_name']} {r['table']}"):
            out += [{"source_file": r["file"], "field": c, "requirement": "import_template_field"} for c in tables[r["table"]]]
    return out


def presence_report(spark, required: Sequence[str], available: Sequence[str]) -> DataFrame:
    """(field, status): which required fields a table has, whatever the case of their names."""
    have = {a.lower() for a in available}
    return spark.createDataFrame([(f, "present" if f.lower() in have else "missing") for f in dict.fromkeys(required)], "field string, status string")
