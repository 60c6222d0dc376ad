"""What rules would do to a table before they are applied: hits, rates and samples by rule and by label, and the rows they label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import condition, with_repeats
from ..functions.text import is_key_name
from .rules import SEVERITY, Rule
from .states import first_of_each, listed


def condition_text(r: Rule) -> str:
    """The condition as a reader would put it: ``amount lt 0``, ``status not_in F, O, P``."""
    value = ", ".join(map(str, r.values)) if r.values else "" if r.value is None else str(r.value)
    return f"{r.field} {r.op} {value}".rstrip()


def labels_of(rules: Sequence[Rule]) -> dict[str, list[int]]:
    """The label of each rule (its reason, else its name) with the places of the rules that give it, in their order."""
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        out.setdefault(r.reason or r.name, []).append(i)
    return out


def _tested(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[Column]]:
    marked, tests = with_repeats(df, [r.condition() for r in rules])
    return marked, [condition(t, marked.columns) for t in tests]


def _key(keys: Sequence[str]) -> Column:
    """Keys joined by ``|``; a key of a composite that is null stays an empty place."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])


def impact(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], samples: int = 10) -> DataFrame:
    """(part, name, severity, condition, rules, hits, rows, rate, sample_keys): a row for each rule and for each label.

    ``part`` is ``rule`` or ``label``. Of a label, ``hits`` sums those of its rules, ``rows`` counts each row once, and the
    severity is the strongest. ``sample_keys`` are the first ``samples`` rows in the order of ``keys``; a task sends no more
    than that many of each. Rules without hits have zeros and an empty list, a table without rows the rate 0; repeated names
    of rules stay rows of their own.
    """
    if not keys:
        raise ValueError("samples need keys")
    marked, hit = _tested(df, rules)
    groups = labels_of(rules)
    any_of = [F.greatest(*[hit[i] for i in g]) if len(g) > 1 else hit[g[0]] for g in groups.values()]
    stronger = lambda g: max((rules[i].severity for i in g), key=SEVERITY.__getitem__)
    told = [("rule", r.name, r.severity, condition_text(r), 1, [i]) for i, r in enumerate(rules)]
    told += [("label", n, stronger(g), "; ".join(condition_text(rules[i]) for i in g), len(g), g) for n, g in groups.items()]
    if not told:
        return df.sparkSession.createDataFrame([], "part string, name string, severity string, condition string, rules int, hits long, rows long, rate double, sample_keys array<string>")
    tests = marked.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], _key(keys).alias("v"), F.array(*hit, *any_of).alias("_t"))
    at = F.col("_t")
    sums = tests.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(at[i], 1)).alias(f"n{i}") for i in range(len(told))])
    each = [
        F.struct(F.lit(place).alias("place"), F.lit(part).alias("part"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(shown).alias("condition"),
                 F.lit(many).alias("rules"), sum((F.col(f"n{i}") for i in of[1:]), F.col(f"n{of[0]}")).alias("hits"), F.col(f"n{place}").alias("rows"))
        for place, (part, name, severity, shown, many, of) in enumerate(told)
    ]
    counted = sums.select("_rows", F.inline(F.array(*each)))
    places = F.filter(F.transform(at, lambda t, i: F.when(t, i)), lambda i: i.isNotNull())
    order = [f"_k{i}" for i in range(len(keys))]
    found = first_of_each(tests.select(*order, "v", F.explode(places).alias("_place")), ["_place"], [*map(F.col, order), F.col("v")], samples)
    rate = F.when(F.col("_rows") > 0, F.round(F.col("rows") / F.col("_rows"), 4)).otherwise(F.lit(0.0))
    joined = counted.join(listed(found, ["_place"], "sample_keys"), F.col("place") == F.col("_place"), "left")
    return joined.select("part", "name", "severity", "condition", "rules", "hits", "rows", rate.alias("rate"), F.coalesce("sample_keys", F.array().cast("array<string>")).alias("sample_keys"))


def labelled_rows(df: DataFrame, rules: Sequence[Rule], order_by: Sequence[str], most: int = 20, output: str = "labels", sep: str = ";") -> DataFrame:
    """The first ``most`` rows that any rule hits, with their distinct labels joined in the order of the rules.

    The labels stand first, then columns named as keys, then the others. A column called ``output`` gives way to the labels.
    """
    marked, hit = _tested(df, rules)
    label = F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(r.reason or r.name)) for h, r in zip(hit, rules)]))), sep) if rules else F.lit("")
    names = [c for c in df.columns if c != output]
    shown = [c for c in names if is_key_name(c)] + [c for c in names if not is_key_name(c)]
    found = marked.select(label.alias(output), *[F.col(f"`{c}`") for c in shown])
    return found.where(F.col(f"`{output}`") != "").orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(most)


def approval_list(df: DataFrame, rules: Sequence[Rule], lookups: int = 0) -> DataFrame:
    """(item, count, rate): what is to be agreed before a job runs: its lookups, rules, labels, and the rows they label."""
    marked, hit = _tested(df, rules)
    some = F.greatest(*hit, F.lit(False)) if hit else F.lit(False)
    worst = [h for h, r in zip(hit, rules) if r.severity == "error"]
    sums = marked.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(some, 1)).alias("hit"), F.count(F.when(F.greatest(*worst, F.lit(False)) if worst else F.lit(False), 1)).alias("worst"))
    share = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 4)).otherwise(F.lit(0.0))
    row = lambda item, count, rate=None: F.struct(F.lit(item).alias("item"), count.cast("long").alias("count"), (F.lit(None).cast("double") if rate is None else rate).alias("rate"))
    return sums.select(F.inline(F.array(
        row("lookups", F.lit(lookups)), row("rules", F.lit(len(rules))), row("labels", F.lit(len(labels_of(rules)))),
        row("rows", F.col("n")), row("labelled rows", F.col("hit"), share("hit")), row("rows with errors", F.col("worst"), share("worst")),
    )))
