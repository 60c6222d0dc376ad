"""Operator 7: token ids in binary shards whose document boundaries are Elias-Fano coded.

Format of a shard image (all little-endian)::

    8 bytes  magic b"LMWSHD01"
    u32      width of an id in bytes (2 or 4)
    u32      l, the number of low bits of a boundary
    u64      n, documents; the boundaries are n + 1 non-decreasing numbers, from 0 to m
    u64      m, ids
    u64      bytes of the low part; then the low bits, l of each boundary, packed from the lowest bit on
    u64      bytes of the high part; then a bit vector with a one at (boundary >> l) + index
    u64      select samples; then u32 positions of every 64th one in the high part
    rest     the ids

The high part takes at most 2 (n + 1) bits and the low part l (n + 1), with l = floor(log2(m / (n + 1))): within half a
bit a boundary of the least possible, where a 64-bit table takes 64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, materialize, pieces, rows_of, schema, shuffle_partitions, text_sizes, tidy, tidy_with_words, word_tokenizer

MAGIC = b"LMWSHD01"
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of numbers, with random access."""

    def __init__(self, low_bits: int, n: int, low: bytes, high: bytes, samples: np.ndarray):
        self.l, self.n, self.low, self.high, self.samples = low_bits, n, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        l = max(0, (top // max(1, n)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(l, n, np.packbits(low, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def values(self) -> np.ndarray:
        """All of them."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.l, bitorder="little").reshape(self.n, self.l)
        return ((ones - np.arange(self.n)) << self.l) + low.astype(np.int64) @ (np.int64(1) << np.arange(self.l, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th, reading only the high bits from the sample before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        ones_before = bin(self.high[byte] & ((1 << skip) - 1)).count("1")
        want = left + ones_before
        while (c := self.high[byte].bit_count()) <= want:
            want -= c
            byte += 1
        b = self.high[byte]
        for _ in range(want):
            b &= b - 1
        high = byte * 8 + (b & -b).bit_length() - 1 - i
        first = i * self.l
        word = int.from_bytes(self.low[first // 8 : (first + self.l + 7) // 8], "little") >> (first % 8)
        return (high << self.l) | (word & ((1 << self.l) - 1))


def shard_image(ids: list[bytes], width: int) -> bytes:
    """One shard of the documents' ids."""
    ends = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype(np.int64)
    ef = EliasFano.of(ends)
    head = MAGIC + struct.pack("<IIQQ", width, ef.l, len(ids), int(ends[-1]))
    parts = [struct.pack("<Q", len(ef.low)), ef.low, struct.pack("<Q", len(ef.high)), ef.high, struct.pack("<Q", len(ef.samples)), ef.samples.tobytes()]
    return b"".join([head, *parts, *ids])


class Shard:
    """A shard image, opened: ``ids(i)`` of one document, ``boundaries`` of all."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.width, l, self.n_docs, self.n_ids = struct.unpack_from("<IIQQ", image, 8)
        at, got = 32, []
        for scale in (1, 1, 4):
            (k,) = struct.unpack_from("<Q", image, at)
            got.append(image[at + 8 : at + 8 + k * scale])
            at += 8 + k * scale
        self.boundaries = EliasFano(l, self.n_docs + 1, got[0], got[1], np.frombuffer(got[2], "<u4"))
        self.flat = np.frombuffer(image, f"<u{self.width}", count=self.n_ids, offset=at)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.boundaries.select(i) : self.boundaries.select(i + 1)]


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 20) -> DataFrame:
    """Encode ``docs``, sorted by doc_id (nulls first, then by text), into shards of about ``shard_ids`` ids, and write them.

    Returns the written table: part, seq (shards in order), base (ids of the part before the shard), n_ids, doc_ids, image.
    Null texts are empty. A document never spans shards; one longer than a shard has its own. Only doc_id is sampled for
    the ranges, so each text is read, moved and encoded once.
    """
    width_limit = shard_ids * 4  # a byte of text gives an id at most, four of a wide one

    @tidy_with_words
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = word_tokenizer(tokenizer), TaskContext.get().partitionId()
        width = 2 if tok.code == "H" else 4
        end = end_id.to_bytes(width, "little")
        seq = base = held = 0
        names: list = []
        ids: list[bytes] = []

        def shard() -> pa.RecordBatch:
            n = held // width
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([shard_image(ids, width)], pa.binary())], ["part", "seq", "base", "n_ids", "doc_ids", "image"])

        for batch in pieces(batches, text_sizes, width_limit):
            for name, x in zip(batch.column("doc_id").to_pylist(), tok.encode(rows_of(batch))):
                if ids and held + len(x) + width > shard_ids * width:
                    yield shard()
                    seq, base, held, names, ids = seq + 1, base + held // width, 0, [], []
                names.append(name)
                ids.append(x + end)
                held += len(x) + width
        if ids:
            yield shard()

    parts = shuffle_partitions(docs.sparkSession)
    ordered = id_and_text(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(encode, schema("part int, seq int, base long, n_ids long, doc_ids array<long>, image binary")), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row for each document of written shards: doc_id, start, n_tokens, ids_crc32. Its place comes from ``select``.

    Only the ids of each part are summed on the driver: as many numbers as there are range partitions.
    """

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, names, image in zip(batch.column("base").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("image")):
                shard = Shard(image.as_buffer().to_pybytes())
                at = np.array([shard.boundaries.select(i) for i in range(shard.n_docs + 1)], np.int64)
                wide = shard.flat.astype("<u4")
                crc = [zlib.crc32(wide[a:b].data) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    totals, before, offsets = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect(), 0, []
    for r in totals:
        offsets.append((r["part"], before))
        before += r["n"]
    spark = shards.sparkSession
    known = F.broadcast(spark.createDataFrame(offsets, schema("part int, before long")))
    placed = shards.join(known, "part").select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "image")
    return placed.mapInArrow(decode, schema("doc_id long, start long, n_tokens long, ids_crc32 long"))
