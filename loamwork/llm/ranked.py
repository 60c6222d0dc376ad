"""Operator 12: ranked lexical search over an inverted index, term at a time with limited accumulators.

The index is partitioned by document: a shard holds, for each term of some megabytes of text, the places of the documents
that have it and how often they have it. Counts over the whole corpus (documents, terms, documents by term) are summed
from the shards first, so that a score is the same in whatever shard it is computed.

In a shard a query's terms are taken from the rarest on. Each posting adds to the accumulator of its document; once k
accumulators are at least as high as everything that the terms still to come could give to a document together, no new
accumulator can reach the first k, and from there on only those that exist are updated, exactly. The k best of each shard
meet in two steps, by query and part of the shards and then by query, so a common term costs each shard its own part.

Scores are integers: weight * ((10^9 * tf) div (1000 * tf + 10 * k1 * m)) with m = 100 - b + ((b * n * N) div L), for n
terms of the document, N documents with terms and L terms of them all; weight = floor(1000 * ln((2N + 2) / (2df + 1))).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import words_of
from .shared import id_and_text, materialize, pieces, rows_of, schema, text_sizes, tidy

#: Parts of the shards in which the best of a query meet first.
PARTS = 64
#: Stands for a missing doc_id inside the index, where lists hold no nulls; it also puts those rows last among ties.
NO_ID = 2**63 - 1


class _Numbers(dict):
    """Terms to numbers in the order in which they are met; with ``only``, all others are -1."""

    def __init__(self, only: list[bytes] | None):
        super().__init__((t, i) for i, t in enumerate(only or ()))
        self.open = only is None

    def __missing__(self, term: bytes) -> int:
        if not self.open:
            return -1
        self[term] = n = len(self)
        return n


def build_ranked_index(docs: DataFrame, terms: set[bytes] | None = None, shard_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of ``docs``, both written.

    postings: shard, term, n (documents), places and counts (u32). documents: shard, doc_ids, lengths (terms with
    repeats). With ``terms`` only their postings are kept, and the index can be asked for them alone.
    """
    only = None if terms is None else sorted(terms)

    @tidy
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, text_sizes, shard_bytes):
            numbers, lengths, ids, first = _Numbers(only), [], [], []
            for place, t in enumerate(rows_of(batch)):
                words = words_of(t)
                lengths.append(len(words))
                met, counts = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
                ids.append(met)
                first.append(np.stack([np.full(len(met), place, np.int64), counts]))
            ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            rest = np.concatenate(first, axis=1) if first else np.zeros((2, 0), np.int64)
            order = np.argsort(ids, kind="stable")
            order = order[np.searchsorted(ids[order], 0) :]  # without the terms that are not asked for
            ids, rest = ids[order], rest[:, order].astype("<u4")
            names = sorted(numbers, key=numbers.get)
            cuts = np.flatnonzero(np.diff(ids, prepend=-1)).tolist() + [len(ids)]
            lists = [(names[ids[a]], b - a, rest[0, a:b].tobytes(), rest[1, a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            shard, seq, n = (part << 32) + seq, seq + 1, len(lists)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * (n + 1), pa.int64()), pa.array([None, *(x[0] for x in lists)], pa.binary()), pa.array([None, *(x[1] for x in lists)], pa.int64()),
                    pa.array([None, *(x[2] for x in lists)], pa.binary()), pa.array([None, *(x[3] for x in lists)], pa.binary()),
                    pa.array([batch.column("doc_id").fill_null(NO_ID).to_pylist()] + [None] * n, pa.list_(pa.int64())), pa.array([lengths] + [None] * n, pa.list_(pa.int64())),
                ],
                ["shard", "term", "n", "places", "counts", "doc_ids", "lengths"],
            )

    both = materialize(id_and_text(docs).mapInArrow(index, schema("shard long, term binary, n long, places binary, counts binary, doc_ids array<long>, lengths array<long>")), "ranked-index")
    return both.where("term is not null").select("shard", "term", "n", "places", "counts"), both.where("term is null").select("shard", "doc_ids", "lengths")


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(places: np.ndarray, counts: np.ndarray, m: np.ndarray, weight: int, k1: int) -> np.ndarray:
    """What each posting of a term adds to its document's score."""
    tf = counts.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 10 * k1 * m[places]))


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents above 0, ties by ascending ``ids``.

    ``lists``: (places, impacts, greatest impact) of each of the query's terms, the rarest first.
    """
    score = np.zeros(len(ids), np.int64)
    has = np.zeros(len(ids), bool)
    remaining = sum(x[2] for x in lists)
    growing = True
    for places, added, most in lists:
        if growing and np.count_nonzero(has) >= k:
            held = score[has]
            # equal scores could still win by a smaller id, so only a greater k-th score ends the growth
            growing = remaining >= np.partition(held, len(held) - k)[len(held) - k]
        remaining -= most
        if growing:
            has[places] = True
        else:
            known = has[places]
            places, added = places[known], added[known]
        score[places] += added
    found = np.flatnonzero(score > 0)
    if len(found) > k:
        found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
    found = found[np.lexsort((ids[found], -score[found]))][:k]
    return found, score[found]


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, k1: int = 2, b: int = 50, shard_bytes: int = 16 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents for each row's text in ``queries`` (item_id, text).

    Equal scores rank by ascending doc_id (rows without one last); documents that score 0 are left out, and so are queries
    without an id or without terms. Queries of one id count together. Rows of ``docs`` count each, also if they are equal or
    share an id; null texts have no terms. ``queries`` are read in blocks of about ``block_bytes`` by a hash of the id: one
    block asks an index of its own terms, more blocks one index of all terms. ``k1`` and ``b`` (a percentage) are those of
    BM25. All arithmetic is in 64-bit integers: b * n * N must stay below 2^63.
    """
    items = queries.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    kind = dict(items.dtypes)["item_id"]
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    index = build_ranked_index(docs, shard_bytes=shard_bytes) if blocks > 1 else None
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        asked: dict = {}
        for r in part.collect():  # bounded by block_bytes
            asked.setdefault(r["item_id"], set()).update(words_of(r["text"].encode()))
        found = _search_block(docs, asked, kind, k, k1, b, shard_bytes, index)
        out = found if out is None else out.union(found)
    return out


def _search_block(docs: DataFrame, asked: dict, kind: str, k: int, k1: int, b: int, shard_bytes: int, index: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    spark, used = docs.sparkSession, set().union(*asked.values())
    postings, documents = index or build_ranked_index(docs, used, shard_bytes)
    names = spark.createDataFrame([(t,) for t in sorted(used)], "term binary")
    if index:
        postings = postings.join(F.broadcast(names), "term", "left_semi")
    lengths = documents.select(F.explode("lengths").alias("n")).where("n > 0")
    n_docs, n_terms = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {bytes(r[0]): r[1] for r in postings.groupBy("term").agg(F.sum("n")).collect()}  # the queries' own terms
    weights = {t: w for t, n in df.items() if (w := weight_of(n_docs, n)) > 0}
    wanted = [(i, sorted((t for t in terms if t in weights), key=lambda t: (df[t], t))) for i, terms in asked.items()]
    sent = spark.sparkContext.broadcast((weights, wanted))

    def look(key, lists: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        weights, wanted = sent.value
        ids = np.array([x for held in shards["doc_ids"] for x in held], np.int64)
        n = np.array([x for held in shards["lengths"] for x in held], np.int64)
        m = 100 - b + (b * n * n_docs) // max(1, n_terms)
        known = {}
        for t, places, counts in zip(lists["term"], lists["places"], lists["counts"]):
            if (t := bytes(t)) in weights:
                at = np.frombuffer(places, "<u4").astype(np.int64)
                added = impacts(at, np.frombuffer(counts, "<u4"), m, weights[t], k1)
                known[t] = (at, added, int(added.max()))
        rows = []
        for item, terms in wanted:
            held = [known[t] for t in terms if t in known]
            places, scores = best_of_shard(held, ids, k) if held else ((), ())
            rows += [(item, int(ids[p]), int(s)) for p, s in zip(places, scores)]
        found = pd.DataFrame(rows, columns=["item_id", "doc_id", "score"])
        found["part"] = int(key[0]) % PARTS
        return found

    # under names of their own, as both sides come from one table
    postings = postings.select(F.col("shard").alias("list_shard"), "term", "places", "counts")
    homes = documents.select(F.col("shard").alias("home_shard"), F.col("doc_ids").alias("doc_ids"), F.col("lengths").alias("lengths"))
    each = postings.groupBy("list_shard").cogroup(homes.groupBy("home_shard")).applyInPandas(look, schema(f"item_id {kind}, doc_id long, score long, part long"))
    order = [F.col("score").desc(), "doc_id"]
    part = each.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
