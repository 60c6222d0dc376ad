"""Operator 3: benchmark passages in training text, by a distributed positional inverted index.

The index is partitioned by document: a shard holds the postings (running word positions) of each term in a few
megabytes of text, delta-coded, a row for each shard and term. A query intersects the lists of its terms inside each
shard, rarest first: those that have all terms near the rarest are proximity matches, and among them, after shifting each
list by the term's offset, the exact phrase matches. Lists never meet outside their shard, so a very common term costs
each shard its own part and no task all of it.

Items are worked off in blocks of bounded size, each against the whole index. One block's terms are sent to all tasks, so
that only postings it can ask for are stored; for more blocks, or for benchmarks to come, the index is built once with all
terms and asked again and again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, materialize, pieces, rows_of, schema, text_sizes, tidy

#: Bytes that end a word: all of ASCII but digits and letters. Upper case is folded.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Places left free between two documents of a shard: no phrase crosses them, and no proximity of fewer words.
GAP = 64


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All runs of ``width`` words; of fewer words, the one run they make."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def phrase_positions(postings: dict[bytes, np.ndarray], terms: tuple[bytes, ...]) -> np.ndarray:
    """Where the phrase starts: lists shifted by their offsets and intersected, from the rarest on."""
    none = np.zeros(0, np.int64)
    lists = sorted(((postings.get(t, none), i) for i, t in enumerate(terms)), key=lambda p: len(p[0]))
    found = lists[0][0] - lists[0][1]
    for positions, offset in lists[1:]:
        if not len(found):
            return found
        at = np.searchsorted(positions, found + offset)
        at[at == len(positions)] = 0
        found = found[positions[at] == found + offset] if len(positions) else none
    return found


def key_term(window: tuple[bytes, ...]) -> bytes:
    """The longest term of a window (of several, the first in byte order): a rare one as a rule, whatever is searched."""
    return min(window, key=lambda t: (-len(t), t))


def proximity_positions(postings: dict[bytes, np.ndarray], terms: Iterable[bytes], slop: int, anchor: bytes | None = None) -> np.ndarray:
    """Positions of ``anchor`` (the rarest term) that have every other term within ``slop`` words on either side."""
    none = np.zeros(0, np.int64)
    lists = sorted((postings.get(t, none) for t in set(terms) if t != anchor), key=len)
    found, rest = (lists[0], lists[1:]) if anchor is None else (postings.get(anchor, none), lists)
    for positions in rest:
        if not len(positions) or not len(found):
            return none
        found = found[np.searchsorted(positions, found + slop, "right") > np.searchsorted(positions, found - slop, "left")]
    return found


def build_index(docs: DataFrame, terms: set[bytes] | None = None, shard_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of ``docs``, both written.

    postings: shard, term, positions (u32 differences). documents: shard, doc_ids, starts (the position of each
    document's first word; ``GAP`` places are left free between documents) and n_words. With ``terms`` only their postings
    are kept; without, the index can be asked for anything.
    """

    @tidy
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, text_sizes, shard_bytes):
            lists: dict[bytes, array] = {} if terms is None else {t: array("q") for t in terms}
            starts, counts, start = [], [], 0
            for t in rows_of(batch):
                words = words_of(t)
                for i, w in enumerate(words, start):
                    if w in lists:
                        lists[w].append(i)
                    elif terms is None:
                        lists[w] = array("q", [i])
                starts.append(start)
                counts.append(len(words))
                start += len(words) + GAP
            kept = [(t, np.diff(np.frombuffer(p, np.int64), prepend=0).astype("<u4").tobytes()) for t, p in lists.items() if p]
            names = batch.column("doc_id").to_pylist()
            shard, seq = (part << 32) + seq, seq + 1
            n = len(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * (n + 1), pa.int64()), pa.array([None, *(k[0] for k in kept)], pa.binary()), pa.array([None, *(k[1] for k in kept)], pa.binary()), pa.array([names] + [None] * n, pa.list_(pa.int64())), pa.array([starts] + [None] * n, pa.list_(pa.int64())), pa.array([counts] + [None] * n, pa.list_(pa.int64()))],
                ["shard", "term", "positions", "doc_ids", "starts", "n_words"],
            )

    both = materialize(id_and_text(docs).mapInArrow(index, schema("shard long, term binary, positions binary, doc_ids array<long>, starts array<long>, n_words array<long>")), "positional-index")
    return both.where("term is not null").select("shard", "term", "positions"), both.where("term is null").select("shard", "doc_ids", "starts", "n_words")


def match_items(docs: DataFrame, items: list[tuple[str, bytes]], width: int = 10, slop: int = 15, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, hit (spans of words, as starts and ends), items (matching ids, sorted), near
    (ids of items with a window all of whose terms stand within ``slop`` words of its ``key_term``, in any order; sorted).

    ``items`` is one block of a benchmark: it is sent to every task, so its size is bounded by the caller. ``index`` is what
    ``build_index`` has made of ``docs``, with all terms or those of the items; without it, it is built here.
    """
    if not width - 1 <= slop < GAP:
        raise ValueError(f"slop must be from {width - 1} to {GAP - 1}")
    windows: dict[tuple[bytes, ...], set[str]] = {}
    for name, text in items:
        for w in windows_of(words_of(text), width):
            windows.setdefault(w, set()).add(name)
    asked = sorted(windows)
    used = {t for w in asked for t in w}
    by_term: dict[bytes, list[int]] = {}
    for i, w in enumerate(asked):  # a shard looks at a window only if it has its key term
        by_term.setdefault(key_term(w), []).append(i)
    stored = index is not None
    postings, documents = index if stored else build_index(docs, used)
    sent = docs.sparkSession.sparkContext.broadcast((asked, [sorted(windows[w]) for w in asked], by_term))
    postings = postings if asked else postings.limit(0)

    def look(key, lists: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        names, starts, counts = (list(np.concatenate([np.asarray(x) for x in shards[c]])) if len(shards) else [] for c in ("doc_ids", "starts", "n_words"))
        phrases, owners, by_term = sent.value
        known = set().union(*phrases) if stored else None
        table = {bytes(t): np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64) for t, p in zip(lists["term"], lists["positions"]) if known is None or bytes(t) in known}
        spans: dict[int, list[tuple[int, int]]] = {}
        matched: dict[int, set[str]] = {}
        close: dict[int, set[str]] = {}
        first = np.asarray(starts, np.int64)
        for phrase, own in ((phrases[i], owners[i]) for t in table for i in by_term.get(t, ())):
            if not all(t in table for t in phrase):
                continue
            near = proximity_positions(table, phrase, slop, key_term(phrase))
            if not len(near):
                continue
            for d in np.unique(np.searchsorted(first, near, "right") - 1).tolist():
                close.setdefault(d, set()).update(own)
            for p in phrase_positions(table, phrase).tolist():
                d = int(np.searchsorted(first, p, "right")) - 1
                spans.setdefault(d, []).append((p - int(first[d]), p - int(first[d]) + len(phrase)))
                matched.setdefault(d, set()).update(own)
        out = range(len(names))
        flat = [[x for s in sorted(set(spans.get(d, ()))) for x in s] for d in out]
        ids = pd.array([None if x is None or x != x else int(x) for x in names], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "n_words": counts, "hit": flat, "items": [sorted(matched.get(d, ())) for d in out], "near": [sorted(close.get(d, ())) for d in out]})

    return postings.groupBy("shard").cogroup(documents.groupBy("shard")).applyInPandas(look, schema("doc_id long, n_words long, hit array<long>, items array<string>, near array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 15, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near, near_items (items whose words come close
    together, exact matches among them; see ``match_items``) for each row of ``docs``.

    A null text has no words. Items whose id is null are left out; items of one id count together. The benchmark is read
    in blocks of about ``block_bytes`` of text by a hash of the id; if there are several, all ask one index of ``docs``, so
    any size works. An empty ``docs`` gives no rows. Repeated rows count each.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        matches = match_items(docs, [(r["item_id"], r["text"].encode()) for r in items.collect()], width, slop)
    else:
        named = materialize(id_and_text(docs).withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
        by_row = named.select(F.col("row").alias("doc_id"), "text")
        index, found = build_index(by_row), []
        for b in range(blocks):
            part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
            found.append(match_items(by_row, [(r["item_id"], r["text"].encode()) for r in part.collect()], width, slop, index))
        every = reduce(DataFrame.union, found).groupBy(F.col("doc_id").alias("row")).agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")])
        matches = named.select("row", "doc_id").join(every, "row")
    return matches.select(
        "doc_id", "n_words", _covered(F.col("hit")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items"),
    )


def _covered(hit):
    """How many words lie in any of the spans (start, end, start, end, ...)."""
    inside = F.transform(F.sequence(F.lit(0), (F.size(hit) / 2 - 1).cast("int")), lambda i: F.sequence(F.get(hit, i * 2), F.get(hit, i * 2 + 1) - 1))
    return F.when(F.size(hit) == 0, F.lit(0).cast("long")).otherwise(F.size(F.array_distinct(F.flatten(inside))).cast("long"))
