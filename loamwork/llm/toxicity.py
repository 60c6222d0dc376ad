"""Operator 11: toxicity, by a convolutional text classifier trained in numpy.

A word's embedding is the mean of the vectors of its hashed features: the word and its beginnings, so that the inflected
forms of an insult share most of it. Filters of several widths slide over the words; each takes its greatest value over the
whole text (max pooling), and a logistic layer reads those. The first dimension starts at the log-odds of a feature among
toxic texts and the first filters at reading it; everything is then trained by gradient descent on logistic loss.

A filter is linear in its words, so its taps are applied to each distinct word of a batch once, and texts only add up rows.

Thresholds are calibrated by language on labelled texts that were not trained on. The language is guessed from the text's
own function words; no other column plays a part. A score of one half is the threshold of the text's language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, pieces, rows_of, schema, text_sizes, tidy

#: Frequent function words of each language, by which texts are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in that is for with as was on at this from are it be by",
    "de": "der die das und den des dem von mit ist im ein eine zu auf nicht auch sich",
    "fr": "le les la et des du est une dans pour que qui sur pas au avec ce",
    "es": "el los las del y que en con por para se una como lo su al",
    "it": "il gli di che e la per con non una sono del della nel",
    "pt": "o os as do da que em com para uma não dos das ao",
    "nl": "de het een van en dat niet op te zijn met voor",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_LISTS = [frozenset(w.encode() for w in words.split()) for words in FUNCTION_WORDS.values()]
#: ASCII marks and white space part words; letters beyond ASCII stay.
_PARTS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lengths of the beginnings of a word that are features of their own.
BEGINNINGS = (2, 3, 4, 5, 6, 7, 8)


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_PARTS).split()


def features_of(word: bytes, buckets: int) -> list[int]:
    """Bucket numbers, from 1 on, of the word and its beginnings; 0 fills the row up."""
    shown = word.decode("utf-8", "replace")
    out = [zlib.crc32(word) % (buckets - 1) + 1]
    out += [zlib.crc32(shown[:n].encode(), n) % (buckets - 1) + 1 for n in BEGINNINGS if n <= len(shown)]
    return out + [0] * (1 + len(BEGINNINGS) - len(out))


def _numbered(texts: Sequence[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words, and each text as their numbers."""
    known: dict[bytes, int] = {}
    out = []
    for t in texts:
        words = words_of(t)
        for w in words:
            if w not in known:
                known[w] = len(known)
        out.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    return list(known), out


def languages_of(words: Sequence[bytes], texts: Sequence[np.ndarray]) -> np.ndarray:
    """For each text the number of the language most of whose function words it has; without any, of ``other``."""
    member = np.zeros((len(words) + 1, len(_LISTS)), np.int64)
    for i, w in enumerate(words):
        if len(w) < 6:
            member[i] = [w in s for s in _LISTS]
    hits = np.array([member[t].sum(0) for t in texts]).reshape(len(texts), len(_LISTS))
    return np.where(hits.max(1, initial=0) > 0, hits.argmax(1), len(_LISTS))


@dataclass
class ConvolutionModel:
    """vectors: buckets x size; taps: size x (all taps of all filters); weights and bias of the last layer; thresholds and
    the scale by language."""

    vectors: np.ndarray
    taps: np.ndarray
    widths: tuple[int, ...]
    filters: int
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray

    def embed(self, words: Sequence[bytes]) -> np.ndarray:
        return _embed(self.vectors, _feature_rows(words, len(self.vectors)))

    def logits(self, words: Sequence[bytes], texts: Sequence[np.ndarray]) -> np.ndarray:
        moved = np.vstack([self.embed(words) @ self.taps, np.zeros((1, self.taps.shape[1]), np.float32)])
        return np.array([_pooled(moved, t, self.widths, self.filters)[0] @ self.weights + self.bias for t in texts])

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """From 0 to 1; one half is the threshold of the text's language."""
        words, numbered = _numbered(texts)
        z = self.logits(words, numbered) - self.thresholds[languages_of(words, numbered)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _feature_rows(words: Sequence[bytes], buckets: int) -> np.ndarray:
    return np.array([features_of(w, buckets) for w in words], np.int32).reshape(len(words), 1 + len(BEGINNINGS))


def _embed(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Means of the vectors of each row's features; vector 0 is zero."""
    total = vectors[rows[:, 0]].copy()
    for j in range(1, rows.shape[1]):
        total += vectors[rows[:, j]]
    return total / np.maximum(1, (rows > 0).sum(1))[:, None].astype(np.float32)


def _pooled(moved: np.ndarray, text: np.ndarray, widths: tuple[int, ...], filters: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of each filter over a text, at least 0, and the place where it begins (-1: nowhere above 0).

    Rows of ``moved`` are the taps of each word; a text that is shorter than a filter is followed by nothing (zeros).
    """
    best, at, tap = np.zeros(len(widths) * filters, np.float32), np.full(len(widths) * filters, -1, np.int64), 0
    for i, width in enumerate(widths):
        here = slice(i * filters, (i + 1) * filters)
        if len(text):
            padded = text if len(text) >= width else np.concatenate([text, np.full(width - len(text), len(moved) - 1, text.dtype)])
            places = len(padded) - width + 1
            value = moved[padded[:places], tap : tap + filters]
            for j in range(1, width):
                value = value + moved[padded[j : j + places], tap + j * filters : tap + (j + 1) * filters]
            where = value.argmax(0)
            top = value[where, np.arange(filters)]
            best[here], at[here] = np.maximum(top, 0), np.where(top > 0, where, -1)
        tap += width * filters
    return best, at


def fit(
    texts: Sequence[bytes], labels: Sequence[int], toxic_share: float | None = None, buckets: int = 1 << 17, size: int = 6, widths: tuple[int, ...] = (1, 2, 3), filters: int = 6,
    rounds: int = 4, rate: float = 0.05, batch: int = 64, calibrate: float = 0.25, seed: int = 11, least: int = 12,
) -> ConvolutionModel:
    """Train on ``texts`` and 0/1 ``labels``; a ``calibrate`` share is kept for the thresholds.

    ``toxic_share`` is the share of toxic texts where the model is used (by default that of ``labels``): errors weigh
    accordingly. A language with fewer than ``least`` texts of either label takes the threshold of all. Without both labels
    every score is below one half, or above if all are toxic.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    words, numbered = _numbered(texts)
    rows = _feature_rows(words, buckets)
    kept = rng.random(len(y)) >= calibrate
    taps_n = sum(widths) * filters
    pools = len(widths) * filters
    vectors = rng.normal(0, 0.05, (buckets, size)).astype(np.float32)
    taps = rng.normal(0, 0.3, (size, taps_n)).astype(np.float32)
    weights = np.full(pools, 1.0 / pools, np.float32)
    if not len(y) or y.min() == y.max():
        sure = 1.0 if len(y) and y[0] == 1 else -1.0
        vectors[:] = 0
        return ConvolutionModel(vectors, taps, tuple(widths), filters, weights, sure, np.zeros(len(LANGUAGES)))
    # log-odds of each feature among toxic texts, in how many of them it occurs
    seen = np.zeros((2, buckets))
    for t, label, k in zip(numbered, y, kept):
        if k:
            seen[int(label), np.unique(rows[np.unique(t)])] += 1
    totals = np.maximum(1, np.array([(kept & (y == v)).sum() for v in (0, 1)]))
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    vectors[:, 0] = odds * np.minimum(1, seen.sum(0) / 5)
    vectors[0] = 0
    first = np.arange(taps_n)
    taps[0, first] += np.repeat([1.0 / w for w in widths for _ in range(w)], filters)
    bias = -float(np.mean([_pooled(np.vstack([_embed(vectors, rows) @ taps, np.zeros((1, taps_n), np.float32)]), t, tuple(widths), filters)[0] @ weights for t in numbered[: min(200, len(numbered))]]))
    squares = [np.full_like(x, 1e-3) for x in (vectors, taps, weights)]
    for _ in range(rounds):
        order = rng.permutation(np.flatnonzero(kept))
        for part in np.array_split(order, max(1, len(order) // batch)):
            near, local = np.unique(np.concatenate([numbered[i] for i in part]), return_inverse=True)
            embedded = _embed(vectors, rows[near])
            moved = np.vstack([embedded @ taps, np.zeros((1, taps_n), np.float32)])
            embedded = np.vstack([embedded, np.zeros((1, size), np.float32)])
            cuts = np.cumsum([0, *(len(numbered[i]) for i in part)])
            g_taps, g_weights, g_bias = np.zeros_like(taps), np.zeros_like(weights), 0.0
            g_words = np.zeros((len(near) + 1, size), np.float32)
            for i, a, b in zip(part, cuts, cuts[1:]):
                text = local[a:b]
                pooled, at = _pooled(moved, text, tuple(widths), filters)
                wrong = float(1 / (1 + np.exp(-np.clip(pooled @ weights + bias, -30, 30))) - y[i])
                g_weights += wrong * pooled
                g_bias += wrong
                tap = 0
                for w_i, width in enumerate(widths):
                    f = np.flatnonzero(at[w_i * filters : (w_i + 1) * filters] >= 0)
                    up = wrong * weights[w_i * filters + f]
                    for j in range(width):
                        place = at[w_i * filters + f] + j
                        word = np.where(place < len(text), text[np.minimum(place, len(text) - 1)], len(near)) if len(text) else np.full(len(f), len(near))
                        g_taps[:, tap + j * filters + f] += embedded[word].T * up
                        np.add.at(g_words, word, up[:, None] * taps[:, tap + j * filters + f].T)
                    tap += width * filters
            touched = np.flatnonzero(np.abs(g_words[:-1]).sum(1) > 0)
            held = rows[near[touched]]
            share = g_words[touched] / np.maximum(1, (held > 0).sum(1))[:, None]
            buckets_hit, back = np.unique(held, return_inverse=True)
            g_vectors = np.zeros((len(buckets_hit), size), np.float32)
            for j in range(held.shape[1]):
                np.add.at(g_vectors, back.reshape(held.shape)[:, j], share)
            scale = 1 / len(part)
            squares[0][buckets_hit] += (g_vectors * scale) ** 2
            vectors[buckets_hit] -= rate * g_vectors * scale / np.sqrt(squares[0][buckets_hit])
            vectors[0] = 0
            for value, g, square in ((taps, g_taps, squares[1]), (weights, g_weights, squares[2])):
                g = g * scale + 1e-4 * value
                square += g**2
                value -= rate * g / np.sqrt(square)
            bias -= rate * g_bias * scale
    model = ConvolutionModel(vectors, taps, tuple(widths), filters, weights, float(bias), np.zeros(len(LANGUAGES)))
    left = np.flatnonzero(~kept)
    if len(left):
        z, lang = model.logits(words, [numbered[i] for i in left]), languages_of(words, [numbered[i] for i in left])
        share = float(y.mean())
        asked = share if toxic_share is None else toxic_share
        cost = ((1 - asked) / max(1e-9, 1 - share)) / max(1e-9, asked / share)
        model.thresholds[:] = threshold(z, y[left], cost)
        for v in range(len(LANGUAGES)):
            own = lang == v
            if min((y[left][own] == 0).sum(), (y[left][own] == 1).sum()) >= least:
                model.thresholds[v] = threshold(z[own], y[left][own], cost)
    return model


def threshold(z: np.ndarray, y: np.ndarray, cost: float = 1.0) -> float:
    """Where the fewest errors are made, false alarms counting ``cost``; in the middle of the widest such gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + cost * (np.sum(y == 0) - np.concatenate([[0], np.cumsum(y == 0)]))
    edges = np.concatenate([[z[0] - 1] if len(z) else [0.0], z, [z[-1] + 1] if len(z) else [0.0]])
    gap = np.where(errors <= errors.min() + 1e-9, np.minimum(np.diff(edges), 4.0), -1)
    best = int(gap.argmax())
    return float((edges[best] + edges[best + 1]) / 2)


def held_out(doc_id):
    """Rows that labels are never learnt from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, sample_bytes: int = 32 << 20, longest: int = 1 << 20, **how) -> ConvolutionModel:
    """Learn from labelled documents that aren't held out, ``sample_rows`` and ``sample_bytes`` of text at most, about half of
    each label, drawn by hashes of doc_id and text; longer texts than ``longest`` bytes are not drawn.

    A doc_id labelled more than once is toxic if any label says so; null ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # at most about sample_rows narrow rows, which may be sent to all executors
    drawn = F.broadcast(known.where(_below("doc_id", {v: sample_rows / 2 / n for v, n in counts.items()})))
    texts = id_and_text(docs).join(drawn, "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    sizes = {r["toxic"]: r["bytes"] for r in texts.groupBy("toxic").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()}
    kept = texts.where(_below("text", {v: sample_bytes / 2 / max(1, size) for v, size in sizes.items()}))
    rows = sorted((r["doc_id"], (r["text"] or "").encode(), r["toxic"]) for r in kept.collect())  # bounded by the sample
    known_share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r[1] for r in rows], [r[2] for r in rows], known_share if 0 < known_share < 1 else None, **how)


def _below(name: str, shares: dict[int, float]):
    """Whether a hash of the column lies in the share of the row's label."""
    test = F.lit(False)
    for label, share in shares.items():
        test = test | ((F.col("toxic") == label) & (F.pmod(F.xxhash64(F.lit("toxicity sample"), F.col(name)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)))
    return test


def score(docs: DataFrame, model: ConvolutionModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, over whole texts; null texts are scored as the empty text.

    Repeated rows and rows without a doc_id are scored each; no other column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(rows_of(batch)).astype(np.float64))], ["doc_id", "score"])

    found = id_and_text(docs).mapInArrow(run, schema("doc_id long, score double"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
