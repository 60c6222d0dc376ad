"""Corpus pipeline: quality, near duplicates, repeated strings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each and reads it back for the next. All
stages but the last return the columns of their input. Counted as part of ``loamwork.llm``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import quality
from loamwork.llm.decontaminate import contamination
from loamwork.llm.packing import pack
from loamwork.llm.shared import bounded, default_tokenizer, materialize
from loamwork.llm.simhash import near_duplicates
from loamwork.llm.suffixes import remove_repeats


#: Texts make long rows. Batches of Spark's usual 4,096 rows (Parquet) and 10,000 rows (Arrow) would hold a whole file of
#: them, in the JVM, outside its heap and in Python, for each task at once.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after its session got the settings of ``BATCHES``. They stay, as what a stage returns is run later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            spark.conf.set(name, str(value))
        return stage(spark, docs, sf_dir)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled documents of the stage's input."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id.

    Groups come from SimHash (operator 8), each link checked on the shingles; an exact check of what it misses follows.

    Of rows that share a doc_id one stays, if none of them is in the group of another document. Rows without a doc_id go.
    """
    groups = materialize(near_duplicates(docs, k=5, similarity=0.8), "pipeline-groups")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias("gone_id"))
    kept = docs.where("doc_id is not null").join(bounded(gone), F.col("doc_id") == F.col("gone_id"), "left_anti")
    twice = materialize(groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("twice_id")), "pipeline-twice")
    if twice.isEmpty():
        return kept
    same = F.col("doc_id") == F.col("twice_id")
    return kept.join(bounded(twice), same, "left_anti").unionByName(kept.join(bounded(twice), same, "left_semi").dropDuplicates(["doc_id"]))


@in_small_batches
def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out of the texts; n_chars follows. No document goes.

    A character that a cut would split goes with it.
    """
    names = docs.columns
    plain = docs.toDF(*["text" if c == "text" else f"column {i}" for i, c in enumerate(names)])  # no name can clash
    left = remove_repeats(plain.withColumn("was null", F.col("text").isNull()), as_text=True)
    text = F.when(~F.col("was null"), F.col("kept"))
    counted = F.when(F.col("n_removed") == 0, F.col(f"column {names.index('n_chars')}")).otherwise(F.char_length(text).cast("long")) if "n_chars" in names else None
    return left.select(*[(text if c == "text" else counted if c == "n_chars" else F.col(f"column {i}")).alias(c) for i, c in enumerate(names)])


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item (or all of a shorter one) go."""
    dirty = contamination(docs, _table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("dirty_id")).distinct()
    return docs.join(bounded(materialize(dirty, "pipeline-dirty")), F.col("doc_id") == F.col("dirty_id"), "left_anti")


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 token ids, as pieces of documents."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Not expressible: a trained classifier, a tokenizer and string overlaps. The tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return materialize(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
