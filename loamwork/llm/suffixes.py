"""Operator 2: bytes covered by long strings that occur more than once, by a distributed merge sort of suffixes.

1. Texts are packed into batches, numbered and written.
2. A sparse set of positions is chosen from content alone: in every window of ``length`` bytes the position whose gram
   has the least hash. Two equal windows choose the same place, so only suffixes from these positions need sorting.
3. Positions whose gram occurs once in the whole table can't lie in a repeat and are dropped (hashes only prune; what
   they let through by chance is told apart below).
4. Each task sorts the suffixes it holds (``length`` bytes from the position on, with the bytes before it as a second
   key) into runs and sends them front-coded: the length of the prefix shared with the suffix before, and the rest.
5. Each receiver merges its runs with a loser tree that keeps, for every contender, the prefix it shares with the last
   winner, and compares only what lies beyond. The merged order comes with the common prefixes of neighbours.
6. From those, and the same for the bytes before, the equal windows around each position follow without comparing pairs.

A gram with more than ``common`` positions would fill one receiver. Its suffixes stay where they are: each batch sends one
row for a window around such a position, with a 128-bit hash and the number of times it has it; sums by hash tell which
windows occur again, and those rows go back to their batch. So a passage that a third of all rows share adds one row a
batch, and no task gets all its places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, give_back, materialize, pieces, rows_of, schema, shuffle_partitions, text_sizes, tidy

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table_of_bytes() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8").copy()


_BYTE_HASH = _table_of_bytes()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.clear()
        _powers[size] = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse))
    return _powers[size]


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash (never 0) of the ``gram`` bytes from each position on."""
    up, down = _power_tables(len(buf))
    total = _BYTE_HASH[buf]
    total *= up[: len(buf)]
    np.cumsum(total, out=total)
    h = total[gram - 1 :].copy()
    h[1:] -= total[:-gram]
    h *= down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


def _sliding(op: np.ufunc, x: np.ndarray, width: int, fill: int) -> np.ndarray:
    """op over every ``width`` neighbours, by running values from the edges of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def chosen_positions(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): in each window of ``length`` bytes inside a document, where the least gram hash stands."""
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = length - gram + 1
    h = gram_hashes(buf, gram)
    least = _sliding(np.minimum, h, span, _MASK)
    edge = np.zeros(len(least) + 1, np.int32)
    some = ends - starts >= length
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, ends[some] - length + 1, -1)
    least[np.cumsum(edge[:-1]) == 0] = 0
    over = _sliding(np.maximum, np.r_[np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)], span, 0)
    at = np.flatnonzero(over == h)
    return at, h[at]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; ``known`` bytes are not looked at again."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def merge_runs(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (string, prefix shared with the one before in its run, payload) into one such run.

    A loser tree. Each contender carries the prefix it shares with the last winner: of two, the longer prefix wins with no
    look at the bytes; equal prefixes are compared from there on, and the loser keeps what it shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    current: list[tuple[bytes, int, object] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = current[a], current[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shared[a], shared[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        s, t = x[0], y[0]
        k = common_prefix(s, t, p)
        if k == len(s) or (k < len(t) and s[k] < t[k]):
            shared[b] = k
            return a, b
        shared[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    won = build(1)
    while current[won] is not None:
        s, _, payload = current[won]
        yield s, shared[won], payload
        following = next(runs[won], None)
        current[won] = following
        if following is not None:
            shared[won] = following[1]
        node = (won + size) // 2
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2


def _pack_batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Written rows (batch, rest, lengths, blob): texts of about ``batch_bytes`` together, compressed; rest: all other columns."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seq, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=5)
        for batch in pieces(batches, text_sizes, batch_bytes):
            texts = rows_of(batch)
            rest = batch.drop_columns(["text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_batch(rest)
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([squeeze.compress(sink.getvalue().to_pybytes())], pa.binary()), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([squeeze.compress(b"".join(texts))], pa.binary())], ["batch", "rest", "lengths", "blob"])
            seq += 1

    return materialize(docs.mapInArrow(pack, schema("batch long, rest binary, lengths array<int>, blob binary")), "suffix-batches")


def _open(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, batch, buffer, starts, ends) of packed batches."""
    import zstandard

    loose = zstandard.ZstdDecompressor()
    for i, (name, lengths, blob) in enumerate(zip(batch.column("batch").to_pylist(), batch.column("lengths").to_pylist(), batch.column("blob").to_pylist())):
        ends = np.cumsum(np.array(lengths, np.int64))
        yield i, name, np.frombuffer(loose.decompress(blob), np.uint8), ends - np.array(lengths, np.int64), ends


def _candidates(packed: DataFrame, length: int, gram: int, common: int) -> DataFrame:
    """(batch, cands array<struct<pos, more, hash, hot>>): chosen positions whose gram occurs again.

    A gram is one row for each batch, with its first position and, packed, the others (a text that repeats one word has
    thousands), so a batch adds one row at most to a common gram.
    """

    @tidy
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, name, buf, starts, ends in _open(batch):
                at, h = chosen_positions(buf, starts, ends, length, gram)
                order = np.argsort(h, kind="stable")
                at, h = at[order].astype("<i4"), h[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.r_[first, len(h)])
                more: list[bytes | None] = [None] * len(first)
                for i in np.flatnonzero(size > 1).tolist():
                    more[i] = at[first[i] + 1 : first[i] + size[i]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.full(len(first), name, np.int64)), pa.array(at[first].astype(np.int32)), pa.array(more, pa.binary())], ["hash", "batch", "pos", "more"])

    # one exchange serves the sums and the join, as both read all its columns (none is ever null but more), so that the
    # positions are neither computed nor moved twice; a gram has a row a batch at most
    spots = packed.select("batch", "lengths", "blob").mapInArrow(choose, schema("hash long, batch long, pos int, more binary")).repartition("hash")
    places = F.lit(1) + F.coalesce(F.octet_length("more") / 4, F.lit(0)).cast("int")
    sums = spots.groupBy("hash").agg(F.sum(places).alias("n"), F.min("batch").alias("batch"), F.min("pos").alias("pos"))
    again = sums.where("n > 1 and batch is not null and pos is not null").select("hash", (F.col("n") > common).alias("hot"))
    kept = spots.join(again, "hash").select("batch", F.struct("pos", "more", "hash", "hot").alias("c"))
    return materialize(kept.groupBy("batch").agg(F.collect_list("c").alias("cands"), F.sum(places_of("c")).alias("places")), "suffix-candidates")


def places_of(struct: str) -> Column:
    return F.lit(1) + F.coalesce(F.octet_length(F.col(f"{struct}.more")) / 4, F.lit(0)).cast("int")


def _sorted_runs(packed: DataFrame, cands: DataFrame, length: int, gram: int, receivers: int, run_entries: int = 30_000) -> DataFrame:
    """Front-coded sorted runs of the suffixes of candidates that aren't hot, a row for each run and receiver."""
    before = length - gram

    @tidy
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int]] = []
        for batch in batches:
            for i, name, buf, starts, ends in _open(batch):
                text = buf.tobytes()
                at, grams, hots = _places(batch.column("cands")[i].values)
                at, grams = at[~hots], grams[~hots]
                doc = np.searchsorted(ends, at, "right")
                for q, h, lo, hi in zip(at.tolist(), grams.tolist(), starts[doc].tolist(), ends[doc].tolist()):
                    held.append((h % receivers, text[q : min(q + length, hi)], text[max(lo, q - before) : q][::-1], name, q))
                    if len(held) >= run_entries:
                        yield _front_coded(held)
                        held = []
        if held:
            yield _front_coded(held)

    columns = "receiver int, heads binary, counts binary, tails binary, lefts binary, places binary"
    return packed.select("batch", "lengths", "blob").join(cands, "batch").select("batch", "lengths", "blob", "cands").mapInArrow(sort, schema(columns))


def _places(found: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, hot) of one batch's candidates."""
    lists = [(np.r_[p, np.frombuffer(m, "<i4")] if m else np.array([p])).astype(np.int64) for p, m in zip(found.field("pos").to_pylist(), found.field("more").to_pylist())]
    sizes = [len(x) for x in lists]
    return np.concatenate(lists), np.repeat(found.field("hash").to_numpy(), sizes), np.repeat(found.field("hot").to_numpy(zero_copy_only=False), sizes)


def _hot_repeats(packed: DataFrame, cands: DataFrame, length: int, gram: int) -> DataFrame:
    """(batch, starts, ends): windows around hot positions that occur again, each batch's own places.

    Not written in between: in one query with ``_sorted_runs`` Spark moves the packed texts once for both.
    """
    before = length - gram

    @tidy
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i, name, buf, starts, ends in _open(batch):
                text = buf.tobytes()
                at, _, hots = _places(batch.column("cands")[i].values)
                at = at[hots]
                doc = np.searchsorted(ends, at, "right")
                alone: set[int] = set()  # one window may hold several hot positions
                for q, lo, hi in zip(at.tolist(), starts[doc].tolist(), ends[doc].tolist()):
                    alone.update(range(max(lo, q - before), min(q, hi - length) + 1))
                by_hash: dict[bytes, list[int]] = {}
                for s in sorted(alone):
                    by_hash.setdefault(xxhash.xxh3_128_digest(text[s : s + length]), []).append(s)
                own = np.array([name], "<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(by_hash), pa.binary()), pa.array([own + np.array(x, "<i4").tobytes() for x in by_hash.values()], pa.binary())], ["hash", "places"])

    @tidy
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("places").to_pylist()
            spots, names = [np.frombuffer(x, "<i4", offset=8) for x in held], [int.from_bytes(x[:8], "little", signed=True) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(spots, pa.list_(pa.int32())), pa.array([x + length for x in spots], pa.list_(pa.int32()))], ["batch", "starts", "ends"])

    hot = cands.where(F.exists("cands", lambda c: c["hot"]))
    found = packed.select("batch", "lengths", "blob").join(hot, "batch").select("batch", "lengths", "blob", "cands").mapInArrow(windows, schema("hash binary, places binary"))
    # one exchange serves the sums and the join, as both read all its columns, so the windows are looked up once; a window
    # has a row a batch at most: 8 bytes that name the batch, 4 for each place
    found = found.repartition("hash")
    again = found.groupBy("hash").agg(F.sum((F.octet_length("places") - 8) / 4).alias("times")).where("times > 1").select("hash")
    return found.join(again, "hash").select("places").mapInArrow(opened, schema("batch long, starts array<int>, ends array<int>"))


def _front_coded(held: list[tuple[int, bytes, bytes, int, int]]) -> pa.RecordBatch:
    import zstandard

    held.sort()
    squeeze, rows, i = zstandard.ZstdCompressor(level=5), [], 0
    while i < len(held):
        receiver, last, last_left = held[i][0], b"", None
        heads, counts, tails, lefts, names, spots = bytearray(), [], [], [], [], []
        while i < len(held) and held[i][0] == receiver:
            _, right, left, name, spot = held[i]
            if left == last_left and right == last and counts:
                counts[-1] += 1
            else:
                k = common_prefix(last, right)
                heads += bytes((k, len(right) - k, len(left)))
                tails.append(right[k:])
                lefts.append(left)
                counts.append(1)
                last, last_left = right, left
            names.append(name)
            spots.append(spot)
            i += 1
        places = np.array(names, "<i8").tobytes() + np.array(spots, "<i4").tobytes()
        rows.append((receiver, bytes(heads), np.array(counts, "<u4").tobytes(), squeeze.compress(b"".join(tails)), squeeze.compress(b"".join(lefts)), squeeze.compress(places)))
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["receiver", "heads", "counts", "tails", "lefts", "places"])


def _read_run(heads: bytes, tails: bytes, lefts: bytes, first: int) -> Iterator[tuple[bytes, int, tuple[int, bytes]]]:
    last, t, l = b"", 0, 0
    for i in range(0, len(heads), 3):
        k, rest, left = heads[i], heads[i + 1], heads[i + 2]
        last = last[:k] + tails[t : t + rest]
        yield last, k, (first + i // 3, lefts[l : l + left])
        t += rest
        l += left


def equal_windows(order: list[tuple[int, int, bytes]], counts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For merged entries (length, prefix shared with the entry before, reversed bytes before; one count each): the
    smallest and largest number of bytes before the position from which a window of ``length`` occurs again (-1: none).

    Two windows that start o bytes before their positions are equal if the positions agree in o bytes before and in
    length - o from there on. Entries that agree so far are neighbours in the merged order, and in the order of the bytes
    before, so both give a class by counting the gaps with a shorter common prefix.
    """
    n = len(order)
    right_len = np.fromiter((e[0] for e in order), np.int64, n)
    right_gap = np.fromiter((e[1] for e in order), np.int64, n)
    lefts = [e[2] for e in order]
    left_len = np.fromiter(map(len, lefts), np.int64, n)
    by_left = sorted(range(n), key=lefts.__getitem__)
    left_gap = np.fromiter((common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])), np.int64, max(0, n - 1))
    by_left = np.array(by_left, np.int64)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for o in range(length - gram + 1):
        r = length - o
        able = (right_len >= r) & (left_len >= o)
        if not able.any():
            continue
        right_class = np.cumsum(right_gap < r)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.r_[0, np.cumsum(left_gap < o)]
        rows = np.flatnonzero(able)
        key = right_class[rows] * (n + 1) + left_class[rows]
        sort = np.argsort(key, kind="stable")
        ranked = key[sort]
        group = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        again = rows[sort][np.bincount(group, weights=counts[rows[sort]])[group] > 1]
        most[again] = o
        least[again[least[again] < 0]] = o
    return least, most


def _repeats(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """(batch, starts, ends): covered spans, from the merged runs of each receiver."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        loose, streams, counts, names, spots, first = zstandard.ZstdDecompressor(), [], [], [], [], 0
        for heads, c, tails, lefts, places in zip(pdf["heads"], pdf["counts"], pdf["tails"], pdf["lefts"], pdf["places"]):
            streams.append(_read_run(heads, loose.decompress(tails), loose.decompress(lefts), first))
            counts.append(np.frombuffer(c, "<u4"))
            raw = loose.decompress(places)
            names.append(np.frombuffer(raw, "<i8", count=len(raw) // 12))
            spots.append(np.frombuffer(raw, "<i4", offset=len(raw) // 12 * 8))
            first += len(counts[-1])
        merged, entry = [], []
        for s, k, (e, left) in merge_runs(streams):
            merged.append((len(s), k, left))
            entry.append(e)
        entry = np.array(entry, np.int64)
        count = np.concatenate(counts).astype(np.int64)
        least, most = equal_windows(merged, count[entry], length, gram)
        low, high = np.empty_like(least), np.empty_like(most)
        low[entry], high[entry] = least, most
        low, high = np.repeat(low, count), np.repeat(high, count)
        name, spot = np.concatenate(names), np.concatenate(spots).astype(np.int64)
        rows = np.flatnonzero(low >= 0)
        rows = rows[np.argsort(name[rows], kind="stable")]
        start = np.flatnonzero(np.r_[True, name[rows][1:] != name[rows][:-1]]) if len(rows) else np.zeros(0, np.int64)
        of = lambda x: pd.Series([p.astype(np.int32) for p in np.split(x, start[1:])] if len(rows) else [], dtype=object)
        give_back()
        return pd.DataFrame({"batch": name[rows][start], "starts": of((spot - high)[rows]), "ends": of((spot + length - low)[rows])})

    return runs.groupBy("receiver").applyInPandas(merge, schema("batch long, starts array<int>, ends array<int>"))


def remove_repeats(docs: DataFrame, length: int = 200, batch_bytes: int = 1 << 19, common: int = 8192, receiver_entries: int = 40_000, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but text, and kept (binary: the bytes left), n_bytes, n_removed, n_spans.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, in the same
    document too; strings are judged on the input and never cross documents. Null texts are empty. A repeated row is a
    repeat of itself. An empty table gives no rows. The four new columns must not be among those of ``docs``. With
    ``as_text`` kept is a string, and a character that a cut would split goes with it. ``length`` is 255 at most.
    """
    if not 2 <= length <= 255:
        raise ValueError("length must be from 2 to 255")
    if clash := {"kept", "n_bytes", "n_removed", "n_spans"} & set(docs.columns):
        raise ValueError(f"docs has columns named as those of the result: {sorted(clash)}")
    gram = length * 58 // 100
    packed = _pack_batches(docs.withColumn("text", F.col("text").cast("string")), batch_bytes)
    cands = _candidates(packed, length, gram, common)
    entries, hot = cands.agg(F.coalesce(F.sum("places"), F.lit(0)), F.coalesce(F.max(F.exists("cands", lambda c: c["hot"])), F.lit(False))).first()
    receivers = max(shuffle_partitions(docs.sparkSession), entries // receiver_entries)
    spans = _repeats(_sorted_runs(packed, cands, length, gram, receivers), length, gram)
    if hot:
        spans = spans.union(_hot_repeats(packed, cands, length, gram))
    cover = materialize(spans.groupBy("batch").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "suffix-spans")
    discard(cands)
    rest = T.StructType([f for f in docs.schema.fields if f.name != "text"])

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for i, _, buf, starts, ends in _open(batch):
                edge = np.zeros(len(buf) + 1, np.int32)
                if batch.column("starts")[i].is_valid:
                    np.add.at(edge, batch.column("starts")[i].values.to_numpy(), 1)
                    np.add.at(edge, batch.column("ends")[i].values.to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept, removed, spans = [], [], []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    g = gone[a:b]
                    n = int(g.sum())
                    kept.append(buf[a:b][~g].tobytes() if n else buf[a:b].tobytes())
                    removed.append(n)
                    spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0)
                raw = zstandard.ZstdDecompressor().decompress(batch.column("rest")[i].as_py())
                others = pa.ipc.open_stream(raw).read_next_batch()
                yield pa.RecordBatch.from_arrays([*others.columns, pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(ends - starts), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], [*others.schema.names, "kept", "n_bytes", "n_removed", "n_spans"])

    out = T.StructType([*rest.fields, *schema(f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long").fields])
    return packed.join(cover, "batch", "left").mapInArrow(cut, out)
