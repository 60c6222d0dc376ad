"""A job: the library's operators in a fixed order over named tables. Building it only composes lazy DataFrames."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.formulas import Formula
from ..operators import audit, detect, lookup, reshape, rows, rules, summarize
from ..operators.profile import guard_removal


@dataclass(frozen=True)
class LookupStep:
    table: str
    left_key: str | Sequence[str]
    right_key: str | Sequence[str]
    fields: Sequence[str]
    options: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class RollupStep:
    table: str
    left_key: str
    right_key: str
    metric: summarize.Metric


@dataclass(frozen=True)
class Job:
    """Steps run in this order whatever the order they are given in: union, unpivot, fixes, renames, lookups, value maps,
    roll-ups, formulas, rules, detectors, split, projection, summary, contract."""

    base: str
    union: Sequence[str] = ()
    unpivot: tuple[Sequence[str], str, str] | None = None
    auto_fix: bool = True
    detect: bool = True
    rename: Mapping[str, str] = field(default_factory=dict)
    lookups: Sequence[LookupStep] = ()
    value_maps: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    rollups: Sequence[RollupStep] = ()
    formulas: Sequence[Formula] = ()
    rules: Sequence[rules.Rule] = ()
    policy: Mapping = field(default_factory=dict)
    target_schema: Sequence[str] = ()
    group_by: Sequence[str] = ()
    metrics: Sequence[summarize.Metric] = ()
    contract: audit.Contract | None = None
    max_removed: float | None = None


@dataclass
class Result:
    detail: DataFrame  # all rows, with issues
    usable: DataFrame
    review: DataFrame
    summary: DataFrame | None
    fixes: DataFrame | None
    steps: list[tuple[str, bool, Observation]] = field(default_factory=list)

    def measured(self, action: Callable[[DataFrame], object]) -> DataFrame:
        """Run ``action`` on the detail rows; (place, step, rows_in, rows_out, removed, matched, flagged, seconds) as it went.

        The counts are observed while the rows pass, with no pass of their own; ``seconds`` is the whole run's, as Spark
        runs steps together. A step that must keep every row and didn't is an error.
        """
        begun = time.time()
        action(self.detail)
        took, rows, before = time.time() - begun, [], None
        for place, (step, keeps, seen) in enumerate(self.steps, 1):
            got = seen.get
            n = got["rows"]
            if keeps and before is not None:
                audit.assert_conserved(before, n, step)
            rows.append((place, step, n if before is None else before, n, 0 if before is None else max(0, before - n), got.get("matched"), got.get("flagged"), took))
            before = n
        return self.detail.sparkSession.createDataFrame(rows, "place int, step string, rows_in long, rows_out long, removed long, matched long, flagged long, seconds double")


def run(job: Job, tables: Mapping[str, DataFrame]) -> Result:
    """Compose the job. Actions happen only where a step depends on data: detectors' facts, guards, declared row counts.

    Every step's rows are observed; ``Result.measured`` runs the job and tells them.
    """
    steps: list[tuple[str, bool, Observation]] = []

    def seen(df: DataFrame, step: str, keeps: bool = True, **counts: Column) -> DataFrame:
        df, o = audit.observed(df, f"{step} {uuid.uuid4().hex}", **counts)
        steps.append((step, keeps, o))
        return df

    df = reshape.union_with_origin({n: tables[n] for n in job.union}) if job.union else tables[job.base]
    if job.unpivot:
        df = reshape.unpivot(df, *job.unpivot)
    df = seen(rows.with_row_id(df), "source")
    fixes = None
    if job.auto_fix:
        fixes = detect.fix_audit(df, [rows.ROW_ID])
        df = detect.auto_fix(df)
    df = reshape.rename(df, job.rename)
    for s in job.lookups:
        df = lookup.lookup(df, tables[s.table], s.left_key, s.right_key, s.fields, **{"policy": "review", "match_field": f"{s.table}_matched", **s.options})
        flag = {"match_field": f"{s.table}_matched", **s.options}["match_field"]
        df = seen(df, f"lookup {s.table}", **({"matched": F.count(F.when(F.col(f"`{flag}`"), 1))} if flag else {}))
    for column, values in job.value_maps.items():
        df = reshape.map_values(df, column, values)
    for s in job.rollups:
        df = seen(lookup.rollup(df, tables[s.table], s.left_key, s.right_key, s.metric), f"rollup {s.table}")
    before = df
    df = seen(rows.apply_formulas(df, job.formulas), "formulas", keeps=False)
    if job.max_removed is not None:
        guard_removal(before, df, job.max_removed)
    if job.detect:
        found = detect.detect(df).withColumn(rules.ISSUES, detect.as_issues()).drop(detect.FINDINGS)
        df = rules.apply_rules(found, job.rules)
    else:
        df = rules.apply_rules(df, job.rules)
    df = seen(df, "rules", flagged=F.count(F.when(F.size(rules.ISSUES) > 0, 1)))
    usable, review = rules.split_usable(df, **job.policy)
    summary = summarize.summarize(usable, job.group_by, job.metrics) if job.metrics else None  # of all columns
    if job.target_schema:
        usable = reshape.project(usable, job.target_schema)
    if job.contract:
        audit.assert_contract(usable, job.contract)
    return Result(df, usable, review, summary, fixes, steps)
