"""Operator 13: runs of words that repeat periodically (maximal repetitions), found by suffix trees.

For a sequence of words Ukkonen's algorithm builds the suffix tree, and another one of the reversed sequence. The Euler
tour of a tree passes the leaves in the order of their suffixes; the depths at which it turns between two leaves, under a
sparse table of minima, give the lowest common ancestor of any two leaves in constant time, and with it the longest common
extension of two positions, forwards (first tree) or backwards (second tree).

Every run has a Lyndon word as its root, by the order of words or by the reversed order, and it is the longest Lyndon word
at its place: the stretch up to the next smaller suffix. So each place gives two candidates (place, period), which are
extended both ways; what reaches two periods is a run, and its period is the smallest.

Trees are only built where a run can be. A run of 24 words or more and three periods or more has each of its 8-grams
twice, so a stretch of fewer than 24 words between places covered by no repeated 8-gram holds none: that test loses
nothing, since equal hashes of unequal 8-grams only keep more, and all work on what stays is done by the trees.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_and_text, pieces, rows_of, schema, text_sizes, tidy

#: Every such gram of a run occurs in it twice, as long as a run has 24 words and three periods at least.
GRAM = 8
LEAST_LENGTH, LEAST_PERIODS = 24, 3


class SuffixTree:
    """Ukkonen's suffix tree of ``word`` (non-negative integers below ``kinds``), with constant-time ``lce``."""

    def __init__(self, word: list[int], kinds: int):
        self.n = len(word)
        parent, child, symbol, start, end, leaf = self._build([*(w + 1 for w in word), 0], kinds + 1)
        # children by parent and symbol; the end mark, 0, is before every word
        order = np.lexsort((symbol, parent))
        self._child, self._symbol = child[order].tolist(), symbol[order].tolist()
        self._at = np.searchsorted(parent[order], np.arange(len(start) + 1)).tolist()
        self._size, self._leaf = (end - start).tolist(), leaf
        leaves, turns = self._tour(up=True)
        self.order = np.array(leaves, np.int64)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[self.order] = np.arange(self.n + 1)
        self._minima = [np.array(turns, np.int32)]
        width = 1
        while 2 * width <= len(turns):
            last = self._minima[-1]
            self._minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _build(s: list[int], kinds: int):
        n = len(s)
        start, end, link = [0], [0], [0]
        to: dict[int, int] = {}  # node * kinds + first symbol of the edge -> node
        leaf: dict[int, int] = {}
        node, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * kinds + s[edge]
                below = to.get(key)
                if below is None:
                    to[key] = leaf_node = len(start)
                    leaf[leaf_node] = len(leaf)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first = start[below]
                    size = min(end[below], i + 1) - first
                    if length >= size:  # further down
                        node, edge, length = below, edge + size, length - size
                        continue
                    if s[first + length] == c:  # the rest is in the tree already
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    split = len(start)
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    leaf[split + 1] = len(leaf)
                    to[key] = split
                    to[split * kinds + c] = split + 1
                    start[below] = first + length
                    to[split * kinds + s[first + length]] = below
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(to, np.int64, len(to))
        return keys // kinds, np.fromiter(to.values(), np.int64, len(to)), keys % kinds, np.array(start), np.array(end), leaf

    def _tour(self, up: bool) -> tuple[array, array]:
        """The leaves of an Euler tour, as starts of their suffixes, and the depth of the turn before each leaf but the first.

        ``up``: children in the order of their symbols, else in the reversed order, the end mark first in both.
        """
        child, symbol, at, size, leaf = self._child, self._symbol, self._at, self._size, self._leaf
        leaves, turns, depth, turn = array("l"), array("i"), [0] * len(size), 0
        stack = [(0, 0)]
        while stack:
            v, turned = stack.pop()
            if turned >= 0:
                turn = turned
            if v in leaf:
                leaves.append(leaf[v])
                turns.append(turn)
                continue
            a, b = at[v], at[v + 1]
            here = depth[v]
            below = child[a:b]
            if not up:
                below = [*below[:1], *reversed(below[1:])] if symbol[a] == 0 else below[::-1]
            for x in reversed(below[1:]):
                depth[x] = here + size[x]
                stack.append((x, here))
            depth[below[0]] = here + size[below[0]]
            stack.append((below[0], -1))
        return leaves, turns[1:]

    def falling_rank(self) -> np.ndarray:
        """Ranks of the suffixes where words compare in the reversed order (a suffix is still after its own prefixes)."""
        rank = np.empty(self.n + 1, np.int64)
        rank[np.array(self._tour(up=False)[0], np.int64)] = np.arange(self.n + 1)
        return rank

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on, for arrays of different positions up to n (the empty suffix)."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            table = self._minima[k]
            out[here] = np.minimum(table[a[here]], table[b[here] - (1 << k)])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the place of the next one that is smaller: there the longest Lyndon word at its place ends."""
    r = rank.tolist()
    out, stack = [0] * (len(r) - 1), [len(r) - 1]
    for i in range(len(r) - 2, -1, -1):
        x = r[i]
        while r[stack[-1]] > x:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(word: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of integers, by start and period.

    A run is as long as its smallest period q allows, and at least ``max(least_length, least_periods * q)``; at least two
    periods in any case.
    """
    n = len(word)
    if n < max(2, least_length):
        return []
    kinds, ids = np.unique(word, return_inverse=True)
    forward = SuffixTree(ids.tolist(), len(kinds))
    place = np.arange(n)
    start = np.concatenate([place, place])
    period = np.concatenate([_next_smaller(forward.rank), _next_smaller(forward.falling_rank())]) - start
    right = forward.lce(start, start + period)
    del forward
    backward = SuffixTree(ids[::-1].tolist(), len(kinds))
    left = backward.lce(n - start, n - start - period)
    length = left + period + right
    kept = (length >= 2 * period) & (length >= np.maximum(least_length, least_periods * period))
    return sorted(set(zip((start - left)[kept].tolist(), length[kept].tolist(), period[kept].tolist())), key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of one group that can hold a run of ``LEAST_LENGTH`` words and ``LEAST_PERIODS`` periods.

    Groups lie side by side. Places that no 8-gram covers which occurs twice in its stretch are cut out, until none is.
    """
    at = np.arange(len(ids))
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        while len(at) >= LEAST_LENGTH:
            same = (at[GRAM - 1 :] - at[: 1 - GRAM] == GRAM - 1) & (group[GRAM - 1 :] == group[: 1 - GRAM])
            h = np.zeros(len(same), np.uint64)
            for k in range(GRAM):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + len(same)]
            h = h ^ (group[: len(same)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            first = np.flatnonzero(same)
            order = np.argsort(h[first], kind="stable")
            g = h[first][order]
            equal = g[1:] == g[:-1]
            again = np.zeros(len(g), bool)
            again[1:] |= equal
            again[:-1] |= equal
            ends = np.zeros(len(at) + 1, np.int64)
            begun = first[order[again]]
            np.add.at(ends, begun, 1)
            np.add.at(ends, begun + GRAM, -1)
            covered = np.cumsum(ends[:-1]) > 0
            edge = np.ones(len(at), bool)
            edge[1:] = ~covered[1:] | ~covered[:-1] | (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])
            piece = np.cumsum(edge)
            covered &= np.bincount(piece)[piece] >= LEAST_LENGTH
            if covered.all() and (len(at) == 0 or len(np.unique(group)) == len(np.unique(piece))):
                break
            at, mixed, group = at[covered], mixed[covered], piece[covered]
    if len(at) < LEAST_LENGTH:
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(group) != 0)) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(at, cut)]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of_texts(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words and its runs, of ``LEAST_LENGTH`` words and ``LEAST_PERIODS`` periods at least."""
    known, split = _Ids(), [t.split() for t in texts]
    counts = [len(w) for w in split]
    ids = np.fromiter((known[w] for words in split for w in words), np.int64, sum(counts))
    group = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(ids, group):
        d = int(group[a])
        found[d] += [(s + a - int(first[d]), length, q) for s, length, q in runs_of(ids[a:b])]
    return [(words, sorted(r, key=lambda x: (x[0], x[2]))) for words, r in zip(split, found)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), strongest, collapsed for each row of ``docs``.

    Words are separated by ASCII white space. ``strongest`` is the run with the greatest length over period (ties: the
    smallest start, then period), null where there is none; ``collapsed`` is the text with one period left of each run. A
    null text has no words; equal rows and rows without a doc_id count each; other columns are left out. Whole texts are
    looked at: a text needs memory of some hundred bytes for each word that may lie in a run.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 4 << 20):
            found = runs_of_texts(rows_of(batch))
            as_rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r in found]
            best = [min(r, key=_weakness) if r else None for _, r in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(w) for w, _ in found], pa.int64()), pa.array(as_rows, pa.list_(run)),
                    pa.array([b and {"start": b[0], "length": b[1], "period": b[2]} for b in best], run),
                    pa.array([collapsed(w, r) for w, r in found], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    kind = "struct<start:long,length:long,period:long>"
    return id_and_text(docs).mapInArrow(find, schema(f"doc_id long, n_words long, runs array<{kind}>, strongest {kind}, collapsed string"))


def _weakness(r: tuple[int, int, int]):
    from fractions import Fraction

    return -Fraction(r[1], r[2]), r[0], r[2]
