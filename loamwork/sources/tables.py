"""Reading many files into named tables, repairing headers, and writing named results."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import neutralize_formulas, numbered_names

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc"}
INVENTORY = "table string, file string, file_name string, format string"


def _suffix(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])


def discover(spark: SparkSession, paths: Sequence[str], recursive: bool = True, prefer: Sequence[str] = ("parquet", "orc", "csv", "tsv", "json", "jsonl", "txt")) -> list[str]:
    """Files of known formats below ``paths``, through Spark's own file systems. Lock files (``~$...``) are left out; of files
    that differ only in suffix the one whose suffix comes first in ``prefer`` stays."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []

    def walk(status, deep: bool) -> None:
        path = status.getPath()
        name = path.getName()
        if name.startswith(("~$", ".", "_")):
            return
        if _suffix(name) in FORMATS:
            found.append(path.toString())
        elif status.isDirectory() and deep:
            for s in path.getFileSystem(conf).listStatus(path):
                walk(s, recursive)

    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for s in path.getFileSystem(conf).globStatus(path) or []:
            walk(s, True)
    best: dict[str, str] = {}
    for f in sorted(found, key=lambda f: (prefer.index(_suffix(f)), f)):
        best.setdefault(re.sub(r"\.[^./]*$", "", f), f)
    return sorted(best.values())


def csv_traits(spark: SparkSession, paths: Sequence[str]) -> tuple[str, bool]:
    """(encoding, whether cells hold line breaks) of CSV files, from one parallel pass over their lines.

    Text that isn't valid UTF-8 is taken as GB18030. A line with an odd number of quotes has a cell that goes on in the next.
    """
    line = F.col("value")
    odd = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    seen = spark.read.text(list(paths)).agg(F.max(~F.is_valid_utf8(line)).alias("other"), F.max(odd % 2 == 1).alias("broken")).first()
    return "GB18030" if seen["other"] else "UTF-8", bool(seen["broken"])


def _csv_reader(spark: SparkSession, sep: str, encoding: str, line_breaks: bool):
    """Files with line breaks in cells can't be split, so they are read whole, one task each; all others are split."""
    if encoding.upper() == "GB18030":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark 4 knows it only so
    return spark.read.option("encoding", encoding).option("sep", sep).option("multiLine", line_breaks).option("escape", '"')


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str | None = None, line_breaks: bool | None = None) -> DataFrame:
    """One table. CSV without a schema is read as text, since detectors need the original cells; type what you need later.

    ``encoding`` and ``line_breaks`` of CSV are found by ``csv_traits`` unless both are given. A byte order mark is no
    part of the first name.
    """
    kind = FORMATS.get(_suffix(path), "parquet")
    if kind != "csv":
        return (spark.read.schema(schema) if schema is not None else spark.read).format(kind).load(path)
    if encoding is None or line_breaks is None:
        found = csv_traits(spark, [path])
        encoding, line_breaks = encoding or found[0], found[1] if line_breaks is None else line_breaks
    reader = _csv_reader(spark, "\t" if _suffix(path) == "tsv" else ",", encoding, line_breaks).option("header", True)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff")) if df.columns and df.columns[0].startswith("\ufeff") else df


def read_tables(spark: SparkSession, paths: Sequence[str], recursive: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by file stem, inventory). Stems that repeat get ``__2``, ``__3``. Of CSV only the traits are looked at here."""
    tables, rows = {}, []
    for f in discover(spark, paths, recursive):
        name, n = _stem(f), 2
        while name in tables:
            name, n = f"{_stem(f)}__{n}", n + 1
        tables[name] = read_table(spark, f)
        rows.append((name, f, f.rsplit("/", 1)[-1], _suffix(f)))
    return tables, spark.createDataFrame(rows, INVENTORY)


def inline_table(spark: SparkSession, records: Sequence[Mapping], most: int = 10_000) -> DataFrame:
    """A few records as a table; columns in order of first appearance, all text unless all values of one are numbers."""
    if len(records) > most:
        raise ValueError(f"inline tables have {most} rows at most")
    names = list(dict.fromkeys(k for r in records for k in r))

    def kind(n: str):
        values = [r[n] for r in records if r.get(n) is not None]
        if values and all(isinstance(v, bool) for v in values):
            return T.BooleanType(), bool
        if values and all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            return T.LongType(), int
        if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            return T.DoubleType(), float
        return T.StringType(), str

    kinds = {n: kind(n) for n in names}
    rows = [tuple(None if r.get(n) is None else kinds[n][1](r[n]) for n in names) for r in records]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, kinds[n][0]) for n in names]))


def _row_kind(cells: Sequence[str], width: int) -> str:
    """What a row above a table may be: blank, a title (one cell of several columns), names (one for each column, all
    different, not only numbers), groups (words with gaps or repeats, as merged cells leave them), or other."""
    padded = [*cells, *[""] * (width - len(cells))]
    filled = [c for c in padded if c]
    if not filled:
        return "blank"
    in_words = not all(re.fullmatch(r"[+-]?([\d,]+\.?\d*|\.\d+)([eE][+-]?\d+)?", c) for c in filled)
    if in_words and len(set(filled)) == len(padded):
        return "names"
    if in_words and len(filled) > 1:
        return "groups"
    return "title" if len(filled) == 1 and width > 1 else "other"


def detect_header(rows: Sequence[Sequence[str | None]], look_at: int | None = None) -> tuple[int, int]:
    """(row, levels) of the header among the first ``look_at`` rows of a grid; (0, 1), the usual case, if in doubt.

    Blank rows and titles are passed over. Names are a header of one level. Groups over names are one of two levels, but
    only with a record below, so that a table's only record is never taken for names. Columns are as many as the rows
    below a candidate usually fill.
    """
    grid = [[str(c).strip() if c is not None else "" for c in r] for r in rows]
    extent = [max((i + 1 for i, c in enumerate(r) if c), default=0) for r in grid]
    for i in range(len(grid) if look_at is None else min(look_at, len(grid))):
        below = sorted(x for x in extent[i + 1 :] if x)
        width = max(extent[i], below[(len(below) - 1) // 2] if below else 0)
        cells = grid[i][: max(width, extent[i])]
        kind = _row_kind(cells, width)
        if kind == "names":
            return i, 1
        if kind == "groups" and i + 2 < len(grid) and _row_kind(grid[i + 1][: max(width, extent[i + 1])], width) == "names":
            return i, 2
        if kind not in ("blank", "title"):
            break
    return 0, 1


def header_names(rows: Sequence[Sequence[str | None]], row: int, levels: int) -> list[str]:
    """Column names from one or two header rows: the upper one is filled to the right, and prefixed only where lower names repeat."""
    lower = [str(c).strip() if c is not None else "" for c in rows[row + levels - 1]]
    if levels == 2:
        upper, last = [], ""
        for c in list(rows[row]) + [None] * (len(lower) - len(rows[row])):
            last = str(c).strip() if c is not None and str(c).strip() else last
            upper.append(last)
        lower = [(f"{u}_{n}" if u and u != n and (lower.count(n) > 1) else n) or u for u, n in zip(upper, lower)]
    return numbered_names([n or f"column_{i + 1}" for i, n in enumerate(lower)])


def read_with_header_repair(spark: SparkSession, paths: Sequence[str], look_at: int = 6, sep: str = ",") -> DataFrame:
    """CSV files whose header may stand below a title or spread over two rows, as one table with ``_file``.

    The first lines of each file (a few cells, whatever the file's size) are looked at on the driver; the header rows are
    then filtered out of the scan. Files with the same names are read together, and all are united by name. Cells to the
    right of the header are kept as column_1, column_2, ... by their place. Two passes before the result find the widest
    row, so that no first line decides how many cells are read. Files without any line give no rows and no columns.
    """
    from pyspark.sql import Window

    encoding, line_breaks = csv_traits(spark, paths)
    line = F.col("value")
    most = spark.read.text(list(paths)).agg(F.max(F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))).alias("n")).first()["n"]
    cells = [f"_c{i}" for i in range((most or 0) + 1)]
    raw = _csv_reader(spark, sep, encoding, line_breaks).option("header", False).option("mode", "PERMISSIVE").schema(", ".join(f"{c} string" for c in cells)).csv(list(paths))
    raw = raw.withColumn("_c0", F.regexp_replace("_c0", "^\ufeff", ""))
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")).withColumn("_cells", F.array(*cells))
    first = placed.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_first"))
    near = placed.where("_block = 0").join(F.broadcast(first), "_file").where(F.col("_at") < F.col("_first") + 2 * look_at + 2)
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    heads: dict[str, list] = {}
    for r in near.withColumn("_n", place).where(F.col("_n") <= look_at + 2).orderBy("_file", "_n").select("_file", "_at", "_cells").collect():
        heads.setdefault(r["_file"], []).append((r["_at"], list(r["_cells"])))
    groups: dict[tuple, list[tuple[str, int]]] = {}
    for f, rows in heads.items():
        row, levels = detect_header([c for _, c in rows], look_at)
        grid = [c for _, c in rows]
        width = max((i + 1 for c in grid[row : row + levels] for i, x in enumerate(c) if x is not None and x.strip()), default=len(cells))
        groups.setdefault(tuple(header_names([c[:width] for c in grid], row, levels)), []).append((f, rows[row + levels - 1][0]))
    if not groups:
        return spark.createDataFrame([], "_file string")
    parts = []
    last = F.greatest(F.lit(0), *[F.when(F.trim(c) != "", i + 1) for i, c in enumerate(cells)])
    for names, files in groups.items():
        ends = F.broadcast(spark.createDataFrame(files, "_file string, _end long"))
        body = placed.join(ends, "_file").where((F.col("_block") > 0) | (F.col("_at") > F.col("_end")))
        body = body.where(F.exists(F.array(*cells), lambda x: F.trim(x) != ""))
        width = body.agg(F.max(last)).first()[0] or 0
        full = numbered_names([*names, *[f"column_{i + 1}" for i in range(len(names), width)]])
        parts.append(body.select(*[F.col(c).alias(n) for c, n in zip(cells, full)], "_file"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_tables(tables: Mapping[str, DataFrame], folder: str, format: str = "parquet", trusted: Sequence[str] = (), mode: str = "overwrite") -> list[str]:
    """One folder for each named table. CSV cells that a spreadsheet would run are made inert, but for ``trusted`` columns."""
    out = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{re.sub(r'[^0-9A-Za-z_一-鿿-]+', '_', name)}"
        if format == "csv":
            neutralize_formulas(df, trusted).write.mode(mode).option("header", True).option("escape", '"').csv(path)
        else:
            df.write.mode(mode).format(format).save(path)
        out.append(path)
    return out


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The result of an earlier job as the input of the next."""
    return spark.read.parquet(path)
