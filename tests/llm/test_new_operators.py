"""Operators 11 to 13: toxicity, ranked search, periodic runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from loamwork.llm import queries, ranked, runs, sharding, suffixes, toxicity
from tests.conftest import SF
from tests.llm.helpers import WORD, ascii_lower, empty_documents, odd_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def smallest_period(s):
    return next(q for q in range(1, len(s) + 1) if all(s[i] == s[i + q] for i in range(len(s) - q)))


def brute_runs(w, least=24, periods=3):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q, 2 * q) and smallest_period(w[i : i + length]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(2, 60))]
        assert runs.runs_of(np.array(w), 2, 2) == brute_runs(w, 2, 2), w


def test_runs_of_texts_with_planted_periods():
    rng = random.Random(4)
    for _ in range(150):
        w = []
        while len(w) < rng.randint(30, 250):
            unit = [rng.randrange(rng.choice([2, 50])) for _ in range(rng.randint(1, 25))]
            w += unit if rng.random() < 0.5 else (unit * 9)[: rng.randint(len(unit), len(unit) * 8)]
        text = " ".join(f"w{x}" for x in w).encode()
        found = runs.runs_of_texts([b"a b", text, b"", text])
        assert found[1][1] == found[3][1] == brute_runs(w)


def test_overlapping_runs_drop_what_any_contains():
    w = [b"a", b"b"] * 15 + [b"a"] * 30
    (_, found), = runs.runs_of_texts([b" ".join(w)])
    assert found == brute_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    assert runs.collapsed(w, found) == b" ".join(kept)


def brute_op13(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_op13_equals_brute_force(spark, tmp_path):
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()))
    expected = sorted(brute_op13(r["doc_id"], r["text"]) for r in texts.collect())
    assert got == expected
    assert sum(r[1] > 0 for r in got) >= 5


def test_op13_odd_and_empty_tables(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, f"{tmp_path}/odd").collect()), key=repr)
    assert got == sorted((brute_op13(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()), key=repr)
    assert any(r[2:5] == (0, 2000, 1) for r in got)
    assert runs.periodic_runs(empty_documents(spark)).collect() == []


def test_a_long_periodic_text(spark):
    unit = [f"w{i}" for i in range(977)]
    text = " ".join(["start", *unit * 60, "end"])
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 977 * 60, 977)]
    assert row["collapsed"] == " ".join(["start", *unit, "end"])


def brute_search(docs, items, k):
    tf = [(d, Counter(TERM.findall(ascii_lower(t or "")))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in tf:
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(ascii_lower(text or ""))) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 4000}, {"shard_bytes": 4000, "block_bytes": 600}])
def test_ranked_search_equals_brute_force(spark, how):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted(map(tuple, ranked.ranked_search(docs, items, k=7, **how).collect()), key=repr)
    assert got == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 7)


def test_ranked_search_of_odd_tables(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "The cat 漢字"), (2, None), (3, ""), (None, "cat"), (4, "nowhere"), (5, "again AGAIN word"), (6, "é Ünïcode")], "item_id long, text string")
    got = sorted(map(tuple, ranked.ranked_search(docs, items, k=50).collect()), key=repr)
    assert got == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.where("item_id is not null").collect()], 50)
    assert ranked.ranked_search(empty_documents(spark), items).collect() == []
    assert ranked.ranked_search(docs, items.limit(0)).collect() == []


def test_accumulators_stop_without_changing_results():
    rng = np.random.default_rng(5)
    grown = []
    for _ in range(200):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        ids = rng.permutation(n).astype(np.int64)
        lists = []
        for size in sorted(rng.integers(1, n + 1, int(rng.integers(1, 12))).tolist()):
            at = np.sort(rng.choice(n, size, replace=False))
            added = rng.integers(1, 1 + 2000 // size, size)
            lists.append((at, added, int(added.max())))
        places, scores = ranked.best_of_shard(lists, ids, k)
        full = np.zeros(n, np.int64)
        for at, added, _ in lists:
            full[at] += added
        order = np.lexsort((ids, -full))
        order = order[full[order] > 0][:k]
        assert ids[places].tolist() == ids[order].tolist() and scores.tolist() == full[order].tolist()
        grown.append(len(places))
    assert max(grown) > 5


def test_toxicity_on_held_out_rows(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    y, ranks = got["toxic"].to_numpy(), got["score"].rank().to_numpy()
    pos, neg = (y == 1).sum(), (y == 0).sum()
    assert (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) > 0.93
    assert (got["predicted"] == y).mean() > 0.96 > neg / len(y) + 0.05
    assert got["predicted"][y == 1].mean() > 0.85 and got["predicted"][y == 0].mean() < 0.02


def test_toxicity_scores_are_those_of_the_formula():
    texts = [b"a clean text of the day", b"you idiot and the others", b"", b"idiot", b"fine words in a row that say nothing", b"what an IDIOTS day"] * 12
    model = toxicity.fit(texts, [0, 1, 0, 1, 0, 1] * 12, buckets=512, size=3, filters=2, rounds=2)
    for text, found in zip(texts[:6], model.scores(texts[:6])):
        words = toxicity.words_of(text)
        e = [np.mean([model.vectors[f] for f in toxicity.features_of(w, 512) if f], axis=0) for w in words]
        pooled, tap = [], 0
        for width in (1, 2, 3):
            padded = e + [np.zeros(3)] * (width - len(e)) if e else []
            for f in range(2):
                values = [sum(padded[i + j] @ model.taps[:, tap + j * 2 + f] for j in range(width)) for i in range(len(padded) - width + 1)]
                pooled.append(max(0.0, *values) if values else 0.0)
            tap += width * 2
        lang = [sum(w.decode() in words.split() for w in toxicity.words_of(text)) for words in toxicity.FUNCTION_WORDS.values()]
        z = np.dot(pooled, model.weights) + model.bias - model.thresholds[int(np.argmax(lang)) if max(lang) else len(lang)]
        assert found == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert (model.scores(texts) >= 0.5).tolist() == [False, True, False, True, False, True] * 12


def test_toxicity_of_odd_tables(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (5, 0), (5, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty_documents(spark), toxicity.train(empty_documents(spark), labels)).collect() == []
    for kept in (labels.limit(0), labels.where("toxic = 1")):
        assert len({r["score"] for r in toxicity.score(docs, toxicity.train(docs, kept)).collect()}) == 1


def test_thresholds_take_the_widest_gap():
    assert toxicity.threshold(np.array([0.0, 1.0, 3.0, 4.0]), np.array([0, 0, 1, 1])) == 2.0
    assert toxicity.threshold(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 1, 0, 1]), cost=0.1) < 1.0


def test_small_groups_of_equal_texts_stay_in_one_shard(spark):
    rng = random.Random(9)
    texts = [f"text {i} " + "x" * rng.randint(20, 400) for i in range(3000)]
    rows = [(t,) for t in texts for _ in range(rng.randint(1, 12))] + [("hot text " * 20,)] * 6000
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, shards=40).join(docs, "doc_id").select("text", "size", "shard").toPandas()
    limit = 0.02 * got["size"].sum() / 40
    groups = got.groupby("text").agg(size=("size", "sum"), shards=("shard", "nunique"))
    assert (groups["shards"][groups["size"] <= limit] == 1).all() and groups["shards"].max() > 5
    shard = got.groupby("shard")["size"].sum()
    assert len(shard) == 40 and shard.max() - shard.min() < 0.1 * shard.mean()


def test_hot_windows_are_looked_up_once(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"start {i * 7919} {passage} end {i * 104729}") for i in range(300)], "doc_id long, text string")
    got = suffixes.remove_repeats(docs, batch_bytes=1 << 14, common=50)
    plain = suffixes.remove_repeats(docs, batch_bytes=1 << 14, common=1 << 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.where("n_removed >= 400").count() == 300
