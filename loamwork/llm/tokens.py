"""Operator 1: how many pieces a unigram tokenizer makes of each text, without making them.

An Aho-Corasick automaton lists all vocabulary matches of a word in one pass; a Viterbi recursion over their ends keeps
only the best score and the number of pieces on that path. Ties fall as in the ``tokenizers`` library's Unigram model:
among matches with the same end the one that starts first is met first, and only a strictly better score replaces it. A
character without a match of its own is an unknown piece with the lowest score less ten; a run of unknown pieces counts
one, or its UTF-8 bytes with byte fallback.

Words are what lies between white space, with the marker before each (as a Metaspace pre-tokenizer does), so counts of a
word are remembered and texts with the same words cost a look-up.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_and_text, pieces, rows_of, schema, text_sizes, tidy

MARKER = "▁"
#: White space as the ``tokenizers`` library has it: Unicode's property, which the separators U+001C to U+001F lack.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
UNKNOWN_PENALTY = 10.0


def piece_file_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(pieces with scores, id of the unknown piece) of a sentencepiece file; its scores are taken as unigram scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())], model.unk_id()


def unigram_file_vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """(pieces with scores, id of the unknown piece, byte fallback) of a ``tokenizers`` file with a Unigram model."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "Unigram":
        raise ValueError(f"{path} holds a {model.get('type')} model, not a Unigram model")
    return [(p, s) for p, s in model["vocab"]], model.get("unk_id") or 0, bool(model.get("byte_fallback"))


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


class PieceCounter:
    """Counts of pieces for words, under one vocabulary. ``keep`` words of ``longest`` characters bound what is remembered."""

    def __init__(self, vocabulary: Iterable[tuple[str, float]], unk_id: int, byte_fallback: bool = True, keep: int = 600_000, longest: int = 64):
        import ahocorasick

        vocabulary = list(vocabulary)
        self.least = min(s for _, s in vocabulary)
        self.known = {p for p, _ in vocabulary}
        last = {p: s for p, s in vocabulary}
        self.single = {p for p in last if len(p) == 1}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.find = ahocorasick.Automaton()
        for p, s in last.items():
            if p:
                self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.keep, self.longest, self.counts = keep, longest, {}

    def count(self, word: str) -> int:
        """Pieces of one pre-tokenized word."""
        n, low = len(word), self.least - UNKNOWN_PENALTY
        score, pieces_to, back = [-math.inf] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        done = 0
        for end, (length, s) in self.find.iter(word):
            end += 1
            while done < end - 1:  # characters before this end that may need an unknown edge
                done += 1
                self._unknown(word, done, score, pieces_to, back, low)
            start = end - length
            at = score[start] + s
            if at > score[end] or back[end] is None or (at == score[end] and start < back[end][0]):
                score[end], pieces_to[end], back[end] = at, pieces_to[start] + 1, (start, False)
        while done < n:
            done += 1
            self._unknown(word, done, score, pieces_to, back, low)
        return pieces_to[n]

    def _unknown(self, word, end, score, pieces_to, back, low) -> None:
        """After all matches that end here: the edge of an unknown character, which starts last and so loses ties."""
        ch = word[end - 1]
        if ch in self.single:
            return
        at = score[end - 1] + low
        if back[end] is None or at > score[end]:
            if self.bytes:
                more = len(ch.encode())
            else:
                more = 0 if end > 1 and back[end - 1] is not None and back[end - 1][1] else 1
            score[end], pieces_to[end], back[end] = at, pieces_to[end - 1] + more, (end - 1, True)

    def of_text(self, text: str) -> int:
        return self.of_words(words_of(text))

    def of_words(self, words: list[str]) -> int:
        known = self.counts
        if len(known) > self.keep:
            known.clear()
        long = 0
        for w in set(words).difference(known):
            # a marker in the text itself begins a piece of its own, as the library's pre-tokenizer splits there
            n = sum(self.count(MARKER + part) for part in w.removeprefix(MARKER).split(MARKER))
            if len(w) <= self.longest:
                known[w] = n
            else:
                long += words.count(w) * n
        return long + sum([known[w] for w in words if w in known]) if long else sum(map(known.__getitem__, words))


_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, piece_file: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens for each row of ``docs``.

    A null or empty text has no tokens. ``piece_file`` is a ``tokenizers`` file with a Unigram model (.json) or a
    sentencepiece file. No row leaves its task.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if piece_file not in _counters:
            _counters[piece_file] = PieceCounter(*(unigram_file_vocabulary if piece_file.endswith(".json") else piece_file_vocabulary)(piece_file))
        counter = _counters[piece_file]
        for batch in pieces(batches, text_sizes, 8 << 20):
            texts = rows_of(batch)
            n_words, n_tokens = [], []
            for t in texts:
                words = words_of(t.decode("utf-8", "replace"))
                n_words.append(len(words))
                n_tokens.append(counter.of_words(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    return id_and_text(docs).mapInArrow(run, schema("doc_id long, n_bytes long, n_words long, n_tokens long"))
