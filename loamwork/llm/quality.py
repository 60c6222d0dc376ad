"""Operator 10: a quality score learnt from preference pairs (Bradley-Terry), thresholded at a quantile of scores.

A document of label 1 is preferred to one of label 0. The chance that a beats b is modelled as sigmoid(w . (x_a - x_b));
w is fitted by logistic loss on differences of feature vectors. The score w . x of a document is then compared with the
quantile of training scores below which the share of label 0 lies, and mapped to 0..1 around it.

Features look at the text alone: shares of kinds of bytes, repetition of words, word triples and lines, word lengths.
Each is cut at its quantiles in the sample into bins, so that the linear model can bend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, pieces, rows_of, schema, text_sizes, tidy

_BYTES = np.arange(256)
_GROUPS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "wide": _BYTES >= 128,
    "newline": _BYTES == 10,
    "space": _BYTES == 32,
    "stop": np.isin(_BYTES, list(b".?,;:")),
    "loud": _BYTES == 33,
    "bar": np.isin(_BYTES, list(b"|")),
    "mark": np.isin(_BYTES, list(b"#$%&*@^~`+=<>{}[]\\_/")),
    "control": (_BYTES < 32) & ~np.isin(_BYTES, [9, 10, 13]),
}
_GROUP_MATRIX = np.stack(list(_GROUPS.values()), axis=1).astype(np.float64)
FEATURES = [*_GROUPS, "log_words", "distinct", "triples", "twice", "lines", "word_length", "short_words", "long_words", "top_word", "worst_line"]


def features(text: bytes) -> list[float]:
    """Of one whole text, in the order of ``FEATURES``; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    share = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _GROUP_MATRIX / len(text)).tolist()
    words = text.split()
    n = len(words)
    if not n:
        return share + [0.0] * (len(FEATURES) - len(share))
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    twice = sum(map(bytes.__eq__, words[1:], words)) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    worst = max((sum(x.count(c) for c in (b"|", b"!", b"#", b"$", b"%", b"&", b"*")) + sum(map(bytes.isupper, x.split())) * 2) / (8 + len(x)) for x in lines) if lines else 0.0
    return [*share, float(np.log1p(n)), len(seen) / n, triples, twice, len(set(lines)) / max(1, len(lines)), float(lengths.mean()), float((lengths <= 3).mean()), float((lengths > 12).mean()), max(seen.values()) / n, worst]


@dataclass
class PairwiseModel:
    """Bin edges of each feature, weights of the bins, the threshold and the scale of the score."""

    edges: list[np.ndarray]
    weights: np.ndarray
    threshold: float
    scale: float

    def spread(self, x: np.ndarray) -> np.ndarray:
        return _spread(x, self.edges)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (self.spread(x) @ self.weights - self.threshold) * self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _spread(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each feature and edge, whether the value is over it (steps, so that neighbours share weights)."""
    return np.concatenate([x[:, i : i + 1] > e[None, :] for i, e in enumerate(edges)], axis=1).astype(np.float64)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 2048, bins: int = 12, steps: int = 400, decay: float = 1e-3, seed: int = 7) -> PairwiseModel:
    """Fit on rows ``x`` of features with labels ``y`` (0 or 1), ``pairs`` drawn for each step. Without both labels every
    score is one half."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    if len(bad):
        edges = [np.unique(np.concatenate([e, np.quantile(x[bad, i], np.linspace(0.05, 0.95, bins))])) for i, e in enumerate(edges)]
    spread = _spread(x, edges)
    if not len(good) or not len(bad):
        return PairwiseModel(edges, np.zeros(spread.shape[1]), 0.0, 1.0)
    spread = spread.astype(np.float32)
    rng = np.random.default_rng(seed)
    w = np.zeros(spread.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        d = spread[rng.choice(good, pairs)] - spread[rng.choice(bad, pairs)]
        grad = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    score = spread @ w
    share = len(bad) / (len(bad) + len(good))
    threshold = float(np.quantile(score, share))
    above = np.median(score[good]) - threshold
    return PairwiseModel(edges, w, threshold, float(3 / max(abs(above), 1e-6)))


def held_out(doc_id):
    """Rows that labels are never learnt from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _with_features(docs: DataFrame, extra: list[str]) -> DataFrame:
    names = ["doc_id", *extra]
    kinds = dict(docs.dtypes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 8 << 20):
            found = pa.array([features(t) for t in rows_of(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], [*names, "x"])

    return docs.mapInArrow(run, schema(", ".join(f"{n} {kinds[n]}" for n in names) + ", x array<double>"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000) -> PairwiseModel:
    """Learn from about ``sample_rows`` labelled documents at most, drawn by a hash of doc_id from all that aren't held out.

    A doc_id labelled more than once counts once, with its lowest label; null ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # the sample is bounded by sample_rows, so it may be sent to all executors and its features to the driver
    rows = _with_features(id_and_text(docs).join(F.broadcast(drawn), "doc_id"), ["quality"]).collect()
    rows = sorted((r["doc_id"], r["x"], r["quality"]) for r in rows)  # so that the order of partitions makes no difference
    x = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_pairs(x, np.array([r[2] for r in rows], np.int64))


def score(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts are scored too, as the empty text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 8 << 20):
            x = np.array([features(t) for t in rows_of(batch)], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    found = id_and_text(docs).mapInArrow(run, schema("doc_id long, score double"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """The rows of ``docs`` whose text scores one half or more, all columns untouched."""
    names = docs.columns
    at = names.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 8 << 20):
            x = np.array([features(t) for t in rows_of(batch)], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    if names.count("text") != 1 or at < 0:
        raise ValueError("documents need one column named text")
    return docs.mapInArrow(run, docs.schema)
