"""What happened to rows and cells, what is delivered, and what reviewers decide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .rules import ISSUES, Rule, issue_text, needs_review
from .reshape import drop_technical


def record_audit(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = (), lookups: Mapping[str, str] | None = None, table: str = "") -> DataFrame:
    """One row for each record and issue, with the field's value. ``dirty:`` reasons go where a rule covers the field.

    ``source`` tells what found it (rule, lookup or detector) and ``rule`` the name of the rule, of ``rules``, or else the
    detector. ``lookups`` names the match column of each lookup: those that found a row and those that did not are joined
    by semicolons, in the order given; a match that is null did not find one.
    """
    by_rule = F.transform(F.filter(F.col(ISSUES), lambda x: ~x["reason"].startswith("dirty:")), lambda x: x["field"])
    kept = F.filter(F.col(ISSUES), lambda x: ~(x["reason"].startswith("dirty:") & F.array_contains(by_rule, x["field"])))
    names = [c for c in df.columns if c != ISSUES]
    values = F.create_map(*[v for c in names for v in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    matched = {n: F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)) for n, c in (lookups or {}).items()}
    hit = F.concat_ws(";", *[F.when(m, F.lit(n)) for n, m in matched.items()])
    failed = F.concat_ws(";", *[F.when(~m, F.lit(n)) for n, m in matched.items()])
    audited = df.select(*keys, values.alias("_values"), hit.alias("hit_lookups"), failed.alias("failed_lookups"), F.inline(kept))
    detected = F.col("reason").startswith("dirty:")
    source = F.when(detected, "detector").when(F.col("kind") == "unmatched_lookup", "lookup").otherwise("rule")
    known = {(r.reason or r.name, r.field): r.name for r in rules}
    rule = F.when(detected, F.regexp_extract("reason", "([^:]*)$", 1))
    for (reason, name), rule_name in known.items():
        rule = rule.when((F.col("reason") == reason) & (F.col("field") == name), rule_name)
    return audited.select(
        *keys, F.lit(table).alias("source_table"), source.alias("source"), rule.otherwise(F.col("reason")).alias("rule"), "hit_lookups", "failed_lookups",
        "reason", "field", "severity", "kind", F.try_element_at("_values", F.col("field")).alias("value"),
    )


def label_summary(df: DataFrame, keys: Sequence[str], samples: int = 3) -> DataFrame:
    """(reason, rows, samples): how many rows have each reason; samples are the smallest keys."""
    each = df.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.explode(F.array_distinct(F.transform(ISSUES, lambda x: x["reason"]))).alias("reason"))
    counts = each.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    # dense_rank is cut off in every task before the shuffle, so a reason that most rows have sends a few keys of each
    place = F.dense_rank().over(Window.partitionBy("reason").orderBy("key"))
    shown = each.withColumn("place", place).where(F.col("place") <= samples).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("samples"))
    return counts.join(F.broadcast(shown), "reason")


def review_tasks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One task for each record and issue; its id is a hash of both, so it stays the same from run to run."""
    each = record_audit(df, keys)
    action = F.when(F.col("severity") == "error", "correct before use").when(F.col("severity") == "warn", "confirm").otherwise("note")
    task = F.concat(F.lit("ANN-"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys], "field", "reason"), 256), 1, 12))
    return each.select(task.alias("task_id"), *keys, "field", "reason", "severity", F.col("kind").alias("category"), action.alias("action"), F.lit("pending").alias("status"))


def task_summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("category", "severity", "status").agg(F.count(F.lit(1)).alias("tasks"))


def business_result(df: DataFrame, passed: str = "通过", open_: str = "需处理", **policy) -> DataFrame:
    """All rows with their status and the reasons in words; no join is needed."""
    return df.withColumn("status", F.when(needs_review(**policy), open_).otherwise(passed)).withColumn("problem", issue_text()).withColumn("reported", F.size(ISSUES) > 0)


def business_summary(df: DataFrame, **policy) -> DataFrame:
    """(item, rows): totals, then each reason."""
    totals = df.agg(F.count(F.lit(1)).alias("all rows"), F.count(F.when(~needs_review(**policy), 1)).alias("usable"), F.count(F.when(needs_review(**policy), 1)).alias("to review")).unpivot([], ["all rows", "usable", "to review"], "item", "rows")
    return totals.unionByName(label_summary(df, df.columns[:1]).select(F.col("reason").alias("item"), "rows"))


def field_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, producer: str = "") -> DataFrame:
    """(keys, field, before, after, change): cells that differ in their text form, nulls compared too. Kept rows only."""
    names = list(columns if columns is not None else [c for c in after.columns if c in before.columns and c not in keys])
    old = before.select(*keys, *[F.col(f"`{c}`").cast("string").alias(f"_b{i}") for i, c in enumerate(names)])
    new = after.select(*keys, *[F.col(f"`{c}`").cast("string").alias(f"_a{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_b{i}").alias("before"), F.col(f"_a{i}").alias("after")) for i, c in enumerate(names)])
    changed = old.join(new, list(keys)).select(*keys, F.inline(F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))))
    kind = F.when(F.col("before").isNull(), "filled").when(F.col("after").isNull(), "cleared").otherwise("changed")
    return changed.withColumn("change", kind).withColumn("producer", F.lit(producer))


def row_actions(before: DataFrame, after: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """The keys of rows that a step removed, with the rule that did."""
    return before.select(*keys).join(after.select(*keys), list(keys), "left_anti").withColumn("action", F.lit("removed")).withColumn("rule", F.lit(rule))


def change_manifest(changes: DataFrame, keys: Sequence[str], by: Sequence[str] = ("field", "change")) -> DataFrame:
    """A line for each kind of change: how many, and the example with the smallest key."""
    example = F.min_by(F.struct("before", "after"), F.struct(*keys))
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("changes"), example.alias("_e")).select(*by, "changes", F.col("_e.before").alias("example_before"), F.col("_e.after").alias("example_after"))


def delivery(df: DataFrame, first: Sequence[str] = (), source_columns: Sequence[str] = (), **policy) -> dict[str, DataFrame]:
    """delivered, withheld and problem tables, without process columns."""
    test = needs_review(**policy)
    plain = lambda d: drop_technical(d.drop(ISSUES), first, source_columns)
    problems = df.where(F.size(ISSUES) > 0).withColumn("problem", issue_text())
    return {"delivered": plain(df.where(~test)), "withheld": plain(df.where(test)), "problems": plain(problems)}


def review_catalogue(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stable ids of the records under review, with issue, field and action."""
    return review_tasks(df.where(F.size(ISSUES) > 0), keys)


def apply_decisions(df: DataFrame, decisions: DataFrame, keys: Sequence[str], **policy) -> tuple[DataFrame, DataFrame]:
    """(result, withheld) after review: accepted rows enter, excluded rows leave, the rest stay where the policy put them.

    ``decisions`` has the keys and ``decision`` (accept, exclude or pending). Where several are given for one record, exclude
    wins over accept, and both over pending.
    """
    weight = F.when(F.col("decision") == "exclude", 2).when(F.col("decision") == "accept", 1).otherwise(0)
    one = decisions.groupBy(*keys).agg(F.max_by("decision", weight).alias("decision"))
    decided = df.join(one, list(keys), "left")
    enters = F.when(F.col("decision") == "accept", True).when(F.col("decision") == "exclude", False).otherwise(~needs_review(**policy))
    return decided.where(enters).drop("decision"), decided.where(~enters)


@dataclass(frozen=True)
class Contract:
    """What a table must look like.

    ``match``: exact (names in order), prefix (these first), subset (these at least), conditional (some of these, in their
    order) or source_dynamic (none but these and ``source_columns``, in any order).
    """

    columns: Sequence[str] = ()
    match: str = "exact"
    rows: int | None = None
    unique: Sequence[str] = field(default_factory=tuple)
    source_columns: Sequence[str] = ()


class ContractBroken(AssertionError):
    """A table or set of tables isn't what was declared."""


def assert_contract(df: DataFrame, spec: Contract) -> DataFrame:
    """Columns are checked before any job runs; the row count only if one is declared."""
    names, want = df.columns, list(spec.columns)
    if len(set(names)) < len(names):
        raise ContractBroken(f"repeated columns: {names}")
    fine = {"exact": names == want, "prefix": names[: len(want)] == want, "subset": set(want) <= set(names), "conditional": names == [c for c in want if c in names], "source_dynamic": set(names) <= {*want, *spec.source_columns}}[spec.match]
    if (want or spec.match == "source_dynamic") and not fine:
        raise ContractBroken(f"columns are {names}, declared {spec.match}: {want}")
    if spec.rows is not None and (n := df.count()) != spec.rows:
        raise ContractBroken(f"{n} rows, declared {spec.rows}")
    if spec.unique and not df.groupBy(*spec.unique).count().where("count > 1").isEmpty():
        raise ContractBroken(f"{list(spec.unique)} repeats")
    return df


def assert_artifacts(tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract]) -> None:
    extra, gone = set(tables) - set(contracts), set(contracts) - set(tables)
    if extra or gone:
        raise ContractBroken(f"undeclared: {sorted(extra)}; missing: {sorted(gone)}")
    for name, spec in contracts.items():
        assert_contract(tables[name], spec)


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """Row count and further counts of a step, collected while it runs: no pass of its own."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]), o


def assert_conserved(before: int, after: int, step: str) -> None:
    if before != after:
        raise ContractBroken(f"{step}: {before} rows in, {after} out")
