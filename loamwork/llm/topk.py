"""Operator 6: exact top-k by inner product, with the k-th score located by histograms.

Every query is scored against every row, in blocks of queries and rows. A pass does not keep the scores: it counts, for
each query, how many fall into each of ``bins`` equal parts of the range still open. The counts of all tasks are summed,
the part that holds the k-th score becomes the new range, and the next pass refines it, until the range is a single
integer: the k-th score. A last pass returns the scores above it and, of those equal to it, the smallest ids, so ties
fall the same way however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, schema, tidy

#: Components are floor(SCALE * x).
SCALE = 256


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part: no null id or vector, no null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(sound)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum is below 2^53, else in longs."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(m).max(initial=0)) * max(1, q.shape[1])
    if top < 1 << 53:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    return q @ m.T


def _blocks(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of up to ``rows`` rows each; shorter vectors are filled up with zeros."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            lists = part.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            matrix = np.zeros((part.num_rows, width), np.int64)
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            matrix[np.repeat(np.arange(part.num_rows), sizes), at] = lists.flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id").to_numpy(zero_copy_only=False), matrix


def _scored(batches, ids: np.ndarray, q: np.ndarray, block_rows: int, query_rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, row ids, scores, own): a block of queries against a block of rows; own marks a query's own id."""
    for row_ids, matrix in _blocks(batches, q.shape[1], block_rows):
        for a in range(0, len(ids), query_rows):
            yield a, row_ids, _scores(q[a : a + query_rows], matrix), ids[a : a + query_rows, None] == row_ids[None, :]


def top_k(vectors: DataFrame, k: int = 5, is_query: Column | None = None, query_block: int = 8192, block_rows: int = 2048, bins: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores among all rows but its own id.

    Queries are the rows of ``is_query`` (by default, ids divisible by 50). Fewer than k candidates: all of them. Ties go
    to the smaller vec_id. Rows that repeat an id count each as candidates; a repeated query id is asked once, with its
    smallest vector. Vectors shorter than the longest count as filled up with zeros. An empty table gives no rows.

    Queries are worked off in blocks of about ``query_block``, which bounds what is sent to the tasks and what thresholds
    come back to the driver; rows are only read where they lie.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors), "topk-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    width, longest = rows.agg(F.max(F.size("v")), F.max(square)).first()
    asked = rows.where(is_query if is_query is not None else F.pmod("vec_id", F.lit(50)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "topk-queries")
    n = asked.count()
    found = [spark.createDataFrame([], schema("query_id long, vec_id long, score long"))]
    blocks = -(-n // query_block)
    for b in range(blocks if width else 0):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        ids = np.array([r["vec_id"] for r in part], np.int64)
        q = np.zeros((len(part), width), np.int64)
        for i, r in enumerate(part):
            q[i, : len(r["v"])] = r["v"]
        kth = _kth_scores(rows, ids, q, k, bins, block_rows, math.isqrt(int(longest)) + 1)
        found.append(materialize(_from(rows, ids, q, kth, k, block_rows), "topk-found"))
    every = reduce(DataFrame.union, found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth_scores(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, bins: int, block_rows: int, longest: int) -> np.ndarray:
    """The k-th highest score of each query (its lowest, if it has fewer), by passes over global histograms."""
    spark = rows.sparkSession
    bound = np.floor(np.sqrt((q.astype(np.float64) ** 2).sum(1)) * longest).astype(np.int64) + 2
    lo, hi, need = -bound, bound.copy(), np.full(len(ids), k, np.int64)
    while (lo < hi).any():
        step = np.maximum(1, -(-(hi - lo + 1) // bins))
        sent = spark.sparkContext.broadcast((ids, q, lo, hi, step))

        @tidy
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, lo, hi, step = sent.value
            total = np.zeros((len(ids), bins), np.int64)
            for a, _, scores, own in _scored(batches, ids, q, block_rows, 256):
                n = len(scores)
                inside = (scores >= lo[a : a + n, None]) & (scores <= hi[a : a + n, None]) & ~own
                at, col = np.nonzero(inside)
                part = (scores[at, col] - lo[a + at]) // step[a + at]
                total[a : a + n] += np.bincount(at * bins + part, minlength=n * bins).reshape(n, bins)
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.int64()))], ["q", "bins"])

        each = rows.mapInArrow(count, schema("q int, bins array<long>"))
        sums = each.groupBy("q").agg(F.array(*[F.sum(F.col("bins")[i]) for i in range(bins)]).alias("bins")).collect()
        done = lo >= hi
        got = np.zeros((len(ids), bins), np.int64)
        for r in sums:
            got[r["q"]] = r["bins"]
        from_top = np.cumsum(got[:, ::-1], axis=1)[:, ::-1]  # scores in this part or above
        enough = from_top >= need[:, None]
        part = np.where(enough.any(1), bins - 1 - np.argmax(enough[:, ::-1], axis=1), -1)
        few = (part < 0) & ~done
        above = np.where(part < bins - 1, np.take_along_axis(np.pad(from_top, ((0, 0), (0, 1))), np.clip(part + 1, 0, bins)[:, None], 1)[:, 0], 0)
        move = ~done & ~few
        new_lo = np.where(move, lo + part * step, np.where(few, -bound, lo))
        hi = np.where(move, np.minimum(hi, new_lo + step - 1), np.where(few, -bound, hi))
        need = np.where(move, need - above, need)
        lo = new_lo
        sent.unpersist()
    return lo


def _from(rows: DataFrame, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, block_rows: int) -> DataFrame:
    """Scores from the k-th on: of each task, k rows a query at most, ties by id."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, q, kth))

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, kth = sent.value
        best = [np.zeros(0, np.int64)] * 3

        def cut(parts: list[np.ndarray]) -> list[np.ndarray]:
            order = np.lexsort((parts[1], -parts[2], parts[0]))
            parts = [p[order] for p in parts]
            start = np.flatnonzero(np.r_[True, parts[0][1:] != parts[0][:-1]]) if len(order) else np.zeros(0, np.int64)
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
            return [p[place < k] for p in parts]

        for a, row_ids, scores, own in _scored(batches, ids, q, block_rows, 256):
            at, col = np.nonzero((scores >= kth[a : a + len(scores), None]) & ~own)
            if len(at):
                best = cut([np.r_[x, y] for x, y in zip(best, cut([at + a, row_ids[col], scores[at, col]]))])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(keep, schema("query_id long, vec_id long, score long"))
