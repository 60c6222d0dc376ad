"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, quality, toxicity
from .decontaminate import contamination
from .packing import pack
from .ranked import ranked_search
from .runs import periodic_runs
from .shared import default_tokenizer
from .sharding import shard_by_bytes
from .simhash import fingerprint_components
from .suffixes import remove_repeats
from .token_files import read_token_shards, write_token_shards
from .tokens import token_counts
from .topk import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.licence_scan(docs, licenses.train(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), window=4096, end_id=2)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_components(table(spark, sf_dir, "documents"), k=3)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50, k1=2, b=50)
    return found.select(F.col("item_id").cast("long").alias("item_id"), "rank", "doc_id", "score")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one of ten documents, by crc32 of the id, the words from a place on become repeats of a few.

    With h = crc32(doc_id), g = h div 10 and n words: if h % 10 = 0, word i from a = g % n on becomes word a + (i - a) % p,
    where p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.array_compact(F.transform(F.split(F.col("text").cast("string"), "[\\x20\\x09-\\x0D]+"), lambda w: F.nullif(w, F.lit(""))))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    cut = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    a = F.expr("cast((h div 10) % n as int)")
    placed = cut.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.expr("1 + cast((n - a) div (3 + (h div 10) % 8) as int)"))
    tail = F.expr("flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int)))")
    changed = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts, op2_suffix_dedup, op3_decontamination, op4_licence_scan, op5_packing, op6_top_k, op7_token_files, op8_simhash, op9_sharding, op10_quality, op11_toxicity,
        op12_ranked_search, op13_periodic_runs,
    )
    return {f.__name__: f for f in every}


_OP12_SQL = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": _OP12_SQL}
