"""Which values, or whole rows, repeat: for one key by a count that is joined back, for many by one narrow shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

#: Keys in one mask of a row.
_BITS = 62


def hashable(c: Column, kind: T.DataType) -> Column:
    """``c`` in a form that Spark hashes and that is equal for equal values: maps as their sorted entries."""
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(hashable(F.map_entries(c), T.ArrayType(entry)))
    if "map<" not in kind.simpleString():
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: hashable(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[hashable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))


def key_hashes(cells: Sequence[Column]) -> list[Column]:
    """Two 64-bit hashes of a key; a null cell is a value of its own, wherever it stands."""
    flat = [x for c in cells for x in (c, c.isNull())]
    return [F.xxhash64(*flat), F.xxhash64(F.lit(1), *reversed(flat))]


def row_cells(df: DataFrame, names: Sequence[str]) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [hashable(F.col(f"`{n}`"), kinds[n]) for n in names]


def mark_repeats(df: DataFrame, keys: Sequence[Column], output: str) -> DataFrame:
    """Adds ``output``: whether the key occurs in another row too (nulls are equal).

    Rows are counted by key with partial sums and the keys that repeat joined back, so a hot key fills no task: Spark sends
    the repeated keys to all tasks if they turn out small, and splits a skewed join otherwise.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    counted = df.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*names, F.lit(True).alias("_again"))
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(counted[n]) for k, n in zip(keys, names)])
    return df.join(counted, same, "left").withColumn(output, F.coalesce("_again", F.lit(False))).drop("_again", *names)


def mark_many(df: DataFrame, keys: Mapping[str, Sequence[Column]], known: Mapping[str, tuple[Column, DataFrame]] | None = None) -> DataFrame:
    """Adds, for each name in ``keys``, whether that key occurs in another row too (nulls are equal).

    All keys share one shuffle of (key number, two hashes), which counts them and keeps a row of each: the rows whose key
    occurs once are known from it, so no second shuffle looks for the others. They are sent back as bit masks in one join:
    scans and joins of the plan do not grow with the number of keys, and no wide row is moved more than once. The rows are
    written first, as their numbers must be the same in all parts of the plan. Keys are compared by two 64-bit hashes.

    ``known``: for further names a key and a table whose one column holds the values to be found; they share the shuffle.
    """
    known = known or {}
    names = [*keys, *known]
    if not names:
        return df
    at = "_row_at"
    base = written(df.withColumn(at, F.monotonically_increasing_id()), "repeats")
    hashes = [key_hashes(cells) for cells in keys.values()] + [key_hashes([c]) for c, _ in known.values()]
    entries = [F.struct(F.lit(i).alias("k"), a.alias("a"), b.alias("b")) for i, (a, b) in enumerate(hashes)]
    narrow = base.select(at, F.inline(F.array(*entries)))
    alone = narrow.where(F.col("k") < len(keys)).groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias(at)).where("n = 1")
    bits = alone.select(at, "k")
    listed = None
    for i, (_, values) in enumerate(known.values(), len(keys)):
        a, b = key_hashes([F.col(f"`{values.columns[0]}`")])
        one = values.distinct().select(F.lit(i).alias("k"), a.alias("a"), b.alias("b"))
        listed = one if listed is None else listed.union(one)
    if listed is not None:
        bits = bits.union(narrow.where(F.col("k") >= len(keys)).join(listed, ["k", "a", "b"], "left_semi").select(at, "k"))
    words = range(-(-len(names) // _BITS))
    bit = F.expr(f"shiftleft(1L, k % {_BITS})")
    masks = [F.bit_or(F.when(F.floor(F.col("k") / _BITS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_mask{w}") for w in words]
    marked = base.join(bits.groupBy(at).agg(*masks), at, "left")
    for i, name in enumerate(names):
        bit_set = F.coalesce(F.col(f"_mask{i // _BITS}").bitwiseAND(F.lit(1 << (i % _BITS))) != 0, F.lit(False))
        marked = marked.withColumn(name, ~bit_set if i < len(keys) else bit_set)
    return marked.drop(at, *[f"_mask{w}" for w in words])
