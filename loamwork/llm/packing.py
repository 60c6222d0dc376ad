"""Operator 5: packing documents into sequences of a fixed length, neighbours found by BM25.

Documents are tokenized and written once, then range-partitioned by a locality key (the least hash of their less common
token ids, then doc_id), so that texts with shared vocabulary tend to meet; the ranges are sampled, and a group of equal
texts is cut like anything else. Each task cuts its stream into index shards of bounded size. In a shard:

* whole windows are cut off long documents; what is left of each is an item;
* an inverted index with BM25 weights is built over the items' token ids, with the document frequencies and the mean
  length of the whole corpus;
* the first unused item, in order of size, is the seed of a window; all its terms are looked up in full, and unused
  neighbours fill the window in order of score. The last one is cut where the window ends, and its rest stays unused;
* where neighbours run out, the next seed goes on filling the same window.

So every window but a shard's last is full, and that one is divided into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, materialize, pieces, rows_of, schema, shuffle_partitions, text_sizes, tidy, tidy_with_words, word_tokenizer

K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ShardIndex:
    """BM25 inverted index over items given as arrays of token ids.

    ``df`` has the number of documents of the whole corpus with each token, ``documents`` and ``mean_length`` their number
    and mean length; without them the items are the corpus.
    """

    def __init__(self, items: list[np.ndarray], df: np.ndarray | None = None, documents: int | None = None, mean_length: float | None = None):
        self.terms, counts = [], []
        for ids in items:
            found, n = np.unique(ids, return_counts=True)
            self.terms.append(found)
            counts.append(n)
        self.n = len(items)
        sizes = np.fromiter(map(len, self.terms), np.int64, self.n)
        flat, tf = np.concatenate(self.terms), np.concatenate(counts).astype(np.float64)
        owner = np.repeat(np.arange(self.n), sizes)
        order = np.argsort(flat, kind="stable")
        self.docs, own = owner[order], flat[order]
        self.first = np.searchsorted(own, np.arange(int(flat.max()) + 2))
        df = np.diff(self.first) if df is None else df
        documents = documents or self.n
        length = np.fromiter(map(len, items), np.float64, self.n)
        norm = K1 * (1 - B + B * length / (mean_length or length.mean()))
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        self.gain = (tf * (K1 + 1) / (tf + norm[owner]))[order] * idf[own]

    def scores(self, item: int) -> np.ndarray:
        """The BM25 score of every item for the distinct terms of one: all its terms, all their lists."""
        spans = [slice(a, b) for a, b in zip(self.first[self.terms[item]].tolist(), self.first[self.terms[item] + 1].tolist())]
        return np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.gain[s] for s in spans]), self.n)

    def neighbours(self, item: int, unused: np.ndarray) -> np.ndarray:
        """Unused items that share a term with the item, best score first, ties by number."""
        score = self.scores(item)
        score[item] = 0
        found = np.flatnonzero(unused & (score > 0))
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(lengths: list[int], items: list[np.ndarray], window: int, *corpus) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, local sequence, offset) for documents whose ids are ``items``; each id in one piece.

    ``corpus``: what ``ShardIndex`` takes of the whole corpus.
    """
    out, sequence = [], 0
    rest = [i for i, n in enumerate(lengths) if n % window]
    for i, n in enumerate(lengths):
        for j in range(n // window):
            out.append((i, j * window, window, sequence, 0))
            sequence += 1
    if not rest:
        return out
    start = [lengths[i] // window * window for i in rest]
    left = [lengths[i] % window for i in rest]
    index = ShardIndex([items[i][s:] for i, s in zip(rest, start)], *corpus)
    unused = np.ones(len(rest), bool)
    at = 0

    def put(item: int) -> None:
        nonlocal sequence, at
        while left[item]:
            n = min(left[item], window - at)
            out.append((rest[item], start[item], n, sequence, at))
            start[item] += n
            left[item] -= n
            at += n
            if at == window:
                sequence, at = sequence + 1, 0
                return

    for seed in sorted(range(len(rest)), key=lambda i: (-left[i], i)):
        if not unused[seed]:
            continue
        put(seed)
        unused[seed] = left[seed] > 0
        if at:
            for other in index.neighbours(seed, unused).tolist():
                put(other)
                unused[other] = left[other] > 0
                if not at:
                    break
        while left[seed]:
            put(seed)
            unused[seed] = False
    if at:
        out = _powers_of_two(out, sequence, at)
    return out


def _powers_of_two(out: list, sequence: int, total: int) -> list:
    """Divide the one unfilled sequence, ``sequence``, at sizes that are powers of two."""
    whole = [p for p in out if p[3] != sequence]
    tail = sorted((p for p in out if p[3] == sequence), key=lambda p: p[4])
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    room, at = sizes.pop(0), 0
    for doc, start, n, _, _ in tail:
        while n:
            k = min(n, room - at)
            whole.append((doc, start, k, sequence, at))
            start, n, at = start + k, n - k, at + k
            if at == room:
                sequence, at, room = sequence + 1, 0, sizes.pop(0) if sizes else 0
    return whole


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """(documents, counts), written together.

    documents: (doc_id, key, n, ids), n ids with the end id, little-endian in 16 bits (32 for large vocabularies). counts:
    (terms, counts), a row for each task: how many of its documents have each token.
    """

    @tidy_with_words
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer)
        kind = np.dtype("<u2" if tok.code == "H" else "<u4")
        end, seen = end_id.to_bytes(kind.itemsize, "little"), np.zeros(max(tok.full.get_vocab_size(), end_id + 1), np.int64)
        names, ints = ["doc_id", "key", "n", "ids", "terms", "counts"], pa.list_(pa.int32())
        for batch in pieces(batches, text_sizes, 4 << 20):
            ids = [x + end for x in tok.encode(rows_of(batch))]
            keys = []
            for x in ids:
                v = np.unique(np.frombuffer(x, kind))
                seen[v] += 1
                v = v.astype(np.uint64)
                v = v[v > 2000] if v[-1] > 2000 else v
                keys.append(int(((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)).min()))
            none = pa.nulls(batch.num_rows, ints)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([len(x) // kind.itemsize for x in ids], pa.int32()), pa.array(ids, pa.binary()), none, none], names)
        found = np.flatnonzero(seen)
        if len(found):
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([found.astype(np.int32)], ints), pa.array([seen[found].astype(np.int32)], ints)], names)

    both = materialize(id_and_text(docs).mapInArrow(encode, schema("doc_id long, key long, n int, ids binary, terms array<int>, counts array<int>")), "packing-ids")
    return both.where("terms is null").select("doc_id", "key", "n", "ids"), both.where("terms is not null").select("terms", "counts")


def corpus_counts(documents: DataFrame, counts: DataFrame, window: int) -> tuple[np.ndarray, int, float, int]:
    """(documents with each token, documents, mean length of what is left of one after whole windows, all ids).

    One row for each token of the vocabulary comes to the driver.
    """
    rows = counts.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("n")).collect()
    df = np.zeros(max((r["terms"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        df[r["terms"]] = r["n"]
    n, mean, total = documents.agg(F.count(F.lit(1)), F.avg(F.pmod("n", F.lit(window))), F.coalesce(F.sum("n"), F.lit(0))).first()
    return df, n, mean or 1.0, total


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_ids: int = 1 << 20, task_ids: int = 1 << 25) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone. Repeated rows and null ids are packed like any others. An empty table
    gives no rows. ``window`` must be a power of two. ``shard_ids`` bounds the ids of one index shard in memory, and a task
    gets about ``task_ids`` or fewer.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    @tidy
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        for batch in _shards(batches, shard_ids):
            names = batch.column("doc_id").to_pylist()
            items = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist())]
            lengths = list(map(len, items))
            placed = pack_shard(lengths, items, window, *sent.value)
            crc = [zlib.crc32(items[d][s : s + n].astype("<u4").data) for d, s, n, _, _ in placed]
            doc, start, length, sequence, offset = map(list, zip(*placed))
            yield pa.RecordBatch.from_arrays([pa.array([names[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([lengths[d] for d in doc], pa.int64()), pa.array(np.array(sequence) + base), pa.array(offset, pa.int64())], PIECES.replace(" long", "").split(", "))
            base += max(sequence) + 1

    ids, counts = tokenized(docs, tokenizer, end_id)
    *corpus, total = corpus_counts(ids, counts, window)
    sent = docs.sparkSession.sparkContext.broadcast(corpus)
    order = ["key", F.col("doc_id").asc_nulls_first()]
    parts = max(shuffle_partitions(docs.sparkSession), -(-total // task_ids))
    near = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    return near.mapInArrow(fill, schema(PIECES))


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together and cut at about ``limit`` ids."""
    held, total = [], 0
    for batch in pieces(batches, lambda b: b.column("n").to_pylist(), limit // 4):
        n = sum(batch.column("n").to_pylist())
        if held and total + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
        held.append(batch)
        total += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
