"""Rules from files: JSON schemas, and sentences or tables in text and Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule, extract_rules, merge_rules, rules_from_json_schema, rules_from_rows

SUFFIXES = ("json", "md", "txt")


def rule_documents(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, kind, text): whole files of the known suffixes at or below ``paths``; a byte order mark is no part of the text.

    ``kind`` is schema (JSON files, and others whose text begins with a brace) or text.
    """
    read = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(SUFFIXES) + "}")
    text = F.regexp_replace("value", "^\ufeff", "")
    is_schema = F.lower("_metadata.file_name").endswith(".json") | text.rlike(r"^\s*\{")
    return read.select(F.col("_metadata.file_path").alias("file"), F.when(is_schema, "schema").otherwise("text").alias("kind"), text.alias("text"))


def read_rules(spark: SparkSession, paths: Sequence[str], fields: Sequence[str], most_schemas: int = 1000) -> list[Rule]:
    """The rules of all files: those of schemas first, files in the order of their paths, then those of sentences about ``fields``.

    Text is searched on Spark and only the rules found are collected; more than ``most_schemas`` schemas are an error.
    """
    documents = rule_documents(spark, paths)
    schemas = documents.where("kind = 'schema'").orderBy("file").limit(most_schemas + 1).collect()
    if len(schemas) > most_schemas:
        raise ValueError(f"over {most_schemas} schemas")
    found = extract_rules(documents.where("kind = 'text'"), fields).orderBy("field", "kind", "value").collect()
    return merge_rules([*(r for s in schemas for r in rules_from_json_schema(s["text"])), *rules_from_rows([r.asDict() for r in found])])
