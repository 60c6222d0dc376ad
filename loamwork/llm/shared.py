"""What the corpus operators share: the scratch folder, written tables, batching of Arrow rows, word tokenizers."""

from __future__ import annotations

import gc
import json
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="spark-loamwork-"))
    return _local_scratch[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts the lineage in a way that outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loamwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables made by ``materialize`` once all that was computed from them is itself written."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """To be sent to all tasks if it has ``rows`` narrow rows at most (they are counted), else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string; every other column is left out, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def give_back() -> None:
    """Return freed memory to the system: Python workers stay alive between tasks, and several share an executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget_words() -> None:
    """Let go of the tokenizers of this Python worker and of all words they know."""
    _tokenizers.clear()


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], words: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back when its task is done.

    ``words``: it uses ``word_tokenizer``. Any other lets go first of what such a task has left in its worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words:
            forget_words()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def tidy_with_words(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``tidy`` for functions that use ``word_tokenizer``."""
    return tidy(f, words=True)


def rows_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], size: Callable[[pa.RecordBatch], list[int]], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` in total size each (one row at least)."""
    for batch in batches:
        start, total = 0, 0
        for i, n in enumerate(size(batch)):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def text_sizes(batch: pa.RecordBatch) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()


#: A word of Latin letters that lower-case one by one (İ doesn't), and ASCII marks after it.
_PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)")


class WordTokenizer(dict):
    """A ``tokenizers`` file whose tokens never span white space: ids of a text are those of its words, and words repeat.

    A dict from words to their ids; a word that is missing is encoded by the library and remembered, if it is no longer
    than ``longest`` bytes. ``keep`` words bound the memory: at half of that, what is known becomes the old half, from
    which words that are met again move back, and the old half before it goes. ASCII letters are lower-cased before
    the look-up where the file's own normalizer lower-cases anyway and nothing in the text could compose with them. Latin
    words, which the file's normalizer only lower-cases and its pre-tokenizer parts from the marks that follow, go straight
    to the model.
    """

    def __init__(self, path: str, keep: int = 1_000_000, longest: int = 64):
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(path)
        self.model, self.keep, self.longest = self.full.model, keep, longest
        spec = json.loads(self.full.to_str())
        kinds = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        if '"Lowercase"' not in kinds or r'[^\\s\\p{L}\\p{N}]+' not in kinds or '"NFC"' not in kinds:
            raise ValueError(f"{path}: its tokens may span white space, so words can't be encoded one by one")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.code = "H" if self.full.get_vocab_size() <= 1 << 16 else "I"
        self.old: dict[bytes, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.as_char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: bytes) -> bytes:
        if word in self.old:
            self[word] = ids = self.old[word]
            return ids
        shown = word.decode("utf-8", "replace")
        plain = _PLAIN_WORD.fullmatch(shown)
        if plain is None:
            ids = array(self.code, self.full.encode(shown, add_special_tokens=False).ids).tobytes()
        elif plain[2]:
            ids = self[plain[1].lower().encode()] + self._marks(plain[2])
        else:
            core = shown.lower()
            core = core if core.isascii() else core.encode().decode("latin-1").translate(self.as_char)
            ids = array(self.code, [t.id for t in self.model.tokenize(core)]).tobytes()
        if len(word) <= self.longest:
            self[word] = ids
        return ids

    def _marks(self, marks: str) -> bytes:
        key = marks.encode()
        return self[key] if key in self else self.__missing__(key)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids, little-endian, in ``code``."""
        if len(self) > self.keep // 2:
            self.old = dict(self)
            self.clear()
        import pyarrow.compute as pc

        lowered = pa.array([self._lower(t) for t in texts], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(lowered)
        words = split.flatten().view(pa.large_binary()).dictionary_encode()  # each different word is looked up once
        known = list(map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = array(self.code).itemsize
        pool, n = np.frombuffer(b"".join(known), f"<u{size}"), np.fromiter(map(len, known), np.int64, len(known)) // size
        begin, codes = np.cumsum(n) - n, words.indices.to_numpy()
        out, ends = [], [np.zeros(1, np.int64)]
        for a in range(0, len(codes), 1 << 20):
            part = codes[a : a + (1 << 20)]
            end = np.cumsum(n[part])
            out.append(pool[np.arange(end[-1]) + np.repeat(begin[part] - end + n[part], n[part])].tobytes())
            ends.append(end + ends[-1][-1])
        ids, ends = b"".join(out), np.concatenate(ends)[split.offsets.to_numpy()] * size
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _lower(self, text: bytes) -> bytes:
        if b"\xcc" in text or b"\xcd" in text or any(s[:2] in text for s in self.special):
            return text
        return text.lower()


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each file and Python worker; a worker that is used again keeps what it knows."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
        gc.freeze()
    return _tokenizers[path]


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
