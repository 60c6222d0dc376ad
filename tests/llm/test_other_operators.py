"""Packing, top-k, token files, sharding, quality and licences against brute force, and on odd tables."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from loamwork.llm import licenses, quality
from loamwork.llm.packing import pack
from loamwork.llm.shared import default_tokenizer
from loamwork.llm.sharding import shard_by_bytes
from loamwork.llm.token_files import EliasFano, Shard, read_token_shards, shard_image, write_token_shards
from loamwork.llm.topk import top_k
from pyspark.sql import functions as F

from ..conftest import SF
from .helpers import empty_documents, odd_documents

tokenizers = pytest.importorskip("tokenizers")


def ids_of(text):
    return np.array(tokenizers.Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 1000, 1001, 10**9], list(range(0, 3000, 7))])
def test_elias_fano_round_trip(values):
    ef = EliasFano.of(np.array(values))
    assert ef.values().tolist() == values and [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_random():
    rng = np.random.default_rng(3)
    for _ in range(30):
        v = np.sort(rng.integers(0, rng.integers(1, 10**7), rng.integers(1, 500)))
        ef = EliasFano.of(v)
        assert ef.values().tolist() == v.tolist() and [ef.select(i) for i in range(0, len(v), 13)] == v[::13].tolist()


def test_shard_image():
    docs = [np.arange(n, dtype="<u2").tobytes() for n in (0, 3, 0, 70)]
    s = Shard(shard_image(docs, 2))
    assert [s.ids(i).tobytes() for i in range(4)] == docs and s.boundaries.values().tolist() == [0, 0, 3, 3, 73]
    with pytest.raises(ValueError):
        Shard(b"something else")


def test_token_files(spark):
    docs = odd_documents(spark)
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_token_shards(write_token_shards(docs, default_tokenizer(), shard_ids=500)).collect())
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for d, t in rows:
        i = ids_of(t)
        want.append((start, d, len(i), zlib.crc32(i.tobytes())))
        start += len(i)
    assert found == want
    assert read_token_shards(write_token_shards(empty_documents(spark), default_tokenizer())).count() == 0


def test_packing(spark):
    docs = odd_documents(spark)
    out = pack(docs, default_tokenizer(), window=256, shard_ids=3000).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 256 and at & (at - 1) == 0
    want = collections.defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(ids_of(r["text"]))
    assert {d: sum(len(i) for i in v) for d, v in want.items()} == {d: sum(n for _, n, _, _ in v) for d, v in by_doc.items()}
    for d, v in want.items():
        if len(v) == 1:
            at = 0
            for start, n, crc, total in sorted(by_doc[d]):
                assert start == at and total == len(v[0]) and crc == zlib.crc32(v[0][start : start + n].tobytes())
                at += n
    assert pack(empty_documents(spark), default_tokenizer()).count() == 0


def test_packing_fills_with_neighbours(spark):
    rng = random.Random(1)
    topics = [["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40)] for _ in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6]) for _ in range(60)) for i in range(120)]
    out = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), default_tokenizer(), window=2048).collect()
    together = collections.defaultdict(collections.Counter)
    for r in out:
        together[r["sequence_id"]][r["doc_id"] % 6] += 1
    share = sum(max(c.values()) for c in together.values()) / len(out)
    assert share > 0.4  # by chance a window of some eight texts would have about a third


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-3, 4, 5) / 8).tolist()) for i in range(230)]
    rows += [(i, rows[0][1]) for i in range(300, 400)] + [(500, None), (501, [None, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (None, [1.0] * 5), (50, rows[1][1]), (504, [0.5]), (505, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id")
    sound = [(i, [int(np.floor(np.float32(x) * 256.0)) for x in v] + [0] * (5 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in sound:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        best = sorted((-int(np.dot(v, w)), i) for i, w in sound if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for options in ({}, {"query_block": 3, "block_rows": 20, "bins": 4}):
        assert sorted(map(tuple, top_k(vectors, **options).collect())) == sorted(want)
    assert top_k(vectors.limit(0)).count() == 0


def test_sharding(spark):
    docs = odd_documents(spark)
    for n in (1, 3, 40):
        out = shard_by_bytes(docs, shards=n).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((r["doc_id"] is not None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        slots = collections.defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < n and r["law"] == "bytes" and r["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_by_bytes(empty_documents(spark)).count() == 0


def test_shards_are_near_equal_with_a_hot_group(spark):
    rng = random.Random(3)
    texts = ["hot text of one group " * 5] * 700 + ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 200))) for _ in range(1400)]
    out = shard_by_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=10, sample_keys=500).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 10
    assert max(abs(s - mean) for s in sizes.values()) < 2 * 216 + 0.04 * mean


def test_quality_is_learnt_and_scores_everything(spark):
    folder = SF.replace("sf0.001", "sf0.01")  # the smallest has a handful of low-quality rows
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == docs.count()
    held = out.join(labels, "doc_id").where("held_out").selectExpr("avg(cast(predicted = quality as int))").first()[0]
    assert held > 0.9
    odd = odd_documents(spark)
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    nothing = quality.train(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, nothing).collect()} == {0.5}
    assert quality.score(empty_documents(spark), model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns


def plain_features(text: bytes) -> dict:
    """The features of a text, one by one in plain Python."""
    kinds = {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "wide": bytes(range(128, 256)), "newline": b"\n", "space": b" ", "stop": b".?,;:",
        "loud": b"!", "bar": b"|", "mark": b"#$%&*@^~`+=<>{}[]\\_/", "control": bytes(b for b in range(32) if b not in (9, 10, 13)),
    }
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    out = {k: sum(b in v for b in text) / len(text) if text else 0.0 for k, v in kinds.items()}
    if not words:
        return out | {k: 0.0 for k in quality.FEATURES if k not in out}
    n = len(words)
    bad = lambda x: sum(x.count(c.encode()) for c in "|!#$%&*") + 2 * sum(w.isupper() for w in x.split())
    return out | {
        "log_words": math.log(1 + n), "distinct": len(set(words)) / n, "triples": len({tuple(words[i : i + 3]) for i in range(n - 2)}) / max(1, n - 2), "twice": sum(words[i] == words[i - 1] for i in range(1, n)) / n,
        "lines": len(set(lines)) / max(1, len(lines)), "word_length": sum(map(len, words)) / n, "short_words": sum(len(w) <= 3 for w in words) / n, "long_words": sum(len(w) > 12 for w in words) / n,
        "top_word": max(words.count(w) for w in set(words)) / n, "worst_line": max((bad(x) / (8 + len(x)) for x in lines), default=0.0),
    }


def test_quality_scores_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    texts = docs.select("doc_id", "text").union(odd_documents(spark).select(F.col("doc_id") + 10**9, "text").where("doc_id is not null")).where("text is null or length(text) < 20000")
    asked = collections.defaultdict(set)
    for r in texts.collect():
        asked[r["doc_id"]].add((r["text"] or "").encode())
    unsure = []
    squash = lambda z: 1 / (1 + math.exp(-min(30, max(-30, (z - model.threshold) * model.scale))))
    for r in quality.score(texts, model).collect():
        possible = []
        for text in asked[r["doc_id"]]:
            x, weights = plain_features(text), iter(model.weights)
            low = high = 0.0
            for name, edges in zip(quality.FEATURES, model.edges):
                for e, w in zip(edges, weights):
                    if e and math.isclose(x[name], e, rel_tol=1e-12):  # may be rounded to either side of the edge
                        low, high = low + min(0, w), high + max(0, w)
                    elif x[name] > e:
                        low, high = low + w, high + w
            possible.append((squash(low), squash(high)))
        assert any(a - 1e-9 <= r["score"] <= b + 1e-9 for a, b in possible)
        unsure += [b - a for a, b in possible]
    assert sum(u < 1e-9 for u in unsure) > len(unsure) / 2


def test_worst_line_counts_all_words_of_a_line():
    at = quality.FEATURES.index("worst_line")
    calm, loud = ["word"] * 100, ["LOUD"] * 100
    assert quality.features(" ".join(calm + loud).encode())[at] == quality.features(" ".join(loud + calm).encode())[at] == 200 / (8 + 999)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.allclose(a.weights, b.weights) and a.threshold == b.threshold


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_licences(spark, licence_model):
    texts = [
        "Some text here.\nReleased under the MIT License.\nMore text.", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "the license of this driver was under review", "no licence at all\nthe work of the author is under the table", None, "", "\n\n", "Copyright (c) 2021. Licensed under the Apache License, Version 2.0. See the file.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in licenses.licence_scan(docs, licence_model).collect()}
    assert found == {0: ("mit", 1), 1: ("apache,cc-by-nc", 2), 2: ("gpl", 1), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("", 0), 7: ("", 0), 8: ("apache", 1)}


def test_short_proprietary_notices(spark, licence_model):
    texts = ["Some text here.\nAll rights reserved.\nMore text.", "Copyright (c) 2020 the authors. All rights reserved.", "all of the rights were reserved for the others", "rights and duties of all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in licenses.licence_scan(docs, licence_model).collect()}
    assert found == {0: ("proprietary", 1), 1: ("proprietary", 1), 2: ("", 0), 3: ("", 0)}


def test_licences_of_odd_rows(spark, licence_model):
    odd = odd_documents(spark)
    assert licenses.licence_scan(odd, licence_model).count() == odd.count()
    assert licenses.licence_scan(empty_documents(spark), licence_model).count() == 0


def test_licence_scan_runs_no_python(spark, licence_model):
    plan = licenses.licence_scan(odd_documents(spark), licence_model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_strong_ngrams_lose_nothing(spark, licence_model):
    """Without the strong n-grams no family reaches the unknown class."""
    weak = [w for g, w in licence_model.weights.items() if g and g not in set(licence_model.strong)]
    n = len(licence_model.families)
    bias = licence_model.weights[""]
    most = sum(max(0.0, max(w[i] - w[-1] for i in range(n - 1))) for w in weak)
    assert max(b - bias[-1] for b in bias[:-1]) + most < 0


def test_neighbours_are_in_full_bm25_order():
    """Against the formula itself, with terms that most items share and with counts of a larger corpus."""
    from loamwork.llm.packing import B, K1, ShardIndex

    rng = np.random.default_rng(11)
    items = [rng.zipf(1.3, rng.integers(1, 60)).clip(1, 400).astype("<u2") for _ in range(700)] + [np.array([1, 2, 3], "<u2")] * 600
    mean = sum(map(len, items)) / len(items)
    for extra in (0, 5000):
        df = np.bincount(np.concatenate([np.unique(i) for i in items]), minlength=402) + extra
        n = len(items) + extra
        index = ShardIndex(items, df, n, mean)
        unused = rng.random(len(items)) < 0.7
        for seed in (0, 5, 300, 900):
            want = []
            for j, other in enumerate(items):
                tf = dict(zip(*np.unique(other, return_counts=True)))
                score = sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(other) / mean)) for t in np.unique(items[seed]) if t in tf)
                if j != seed and unused[j] and score > 0:
                    want.append((-round(float(score), 9), j))
            got = index.neighbours(seed, unused)
            score = index.scores(seed)
            assert [(-round(float(score[j]), 9), j) for j in got] == sorted(want)


def test_packing_counts_the_whole_corpus(spark):
    from loamwork.llm.packing import corpus_counts, tokenized

    docs = odd_documents(spark)
    df, n, mean, total = corpus_counts(*tokenized(docs, default_tokenizer(), 2), 256)
    ids = [ids_of(r["text"]) for r in docs.collect()]
    assert n == len(ids) and total == sum(map(len, ids)) and abs(mean - np.mean([len(i) % 256 for i in ids])) < 1e-9
    assert df.tolist() == np.bincount(np.concatenate([np.unique(i) for i in ids])).tolist()


def test_overfull_ranges_are_divided(spark):
    """One long text, one hot text of equal rows, and few planned ranges: no range of several rows stays over its limits."""
    from loamwork.llm import sharding
    from pyspark.sql import functions as F

    rows = [(7, "same row " * 3)] * 900 + [(i, "x" * (i % 50)) for i in range(600)] + [(9999, "y" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    keep = sharding._on_the_line
    try:
        sharding._on_the_line = lambda at, *rest: seen.append(at) or keep(at, *rest)
        out = shard_by_bytes(docs, shards=4, sample_keys=4, max_range_rows=100)
    finally:
        sharding._on_the_line = keep
    sizes = seen[0].groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 100 and len(sizes) >= 16
    assert out.count() == len(rows)
    per = {r["shard"]: r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert sum(per.values()) == sum(len(t) + 16 for _, t in rows)


def test_wrapped_and_several_licences(spark, licence_model):
    grant = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"
    texts = [
        f"Prose before.\n\n{grant}\n\nProse after.", "Released under the MIT License. All rights reserved. " + "Plain words follow here. " * 3, "This work is licensed under the GNU General\nPublic License, version 3.",
        "Permission is hereby granted\n\nto any person who asks for it", "All rights reserved.\n" * 3, "x" * 5000 + " Licensed under CC BY-SA 4.0.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in licenses.licence_scan(docs, licence_model).collect()}
    assert found == {0: ("mit", 1), 1: ("mit,proprietary", 1), 2: ("gpl", 1), 3: ("", 0), 4: ("proprietary", 3), 5: ("cc-by-sa", 1)}


def test_the_licence_model_is_calibrated_and_does_not_depend_on_partitions(spark, licence_model):
    assert licence_model.recall >= 0.9 and licence_model.false_alarms <= 0.01
    again = licenses.train(spark.read.parquet(f"{SF}/documents.parquet").repartition(7))
    assert abs(again.threshold - licence_model.threshold) < 1e-6 and again.strong == licence_model.strong


def test_licence_scan_equals_brute_force(spark, licence_model):
    """The same model applied by plain Python to every line of the smallest documents."""
    import re

    def grams(t):
        w = [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
        return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}

    n = len(licence_model.families)

    def families(t):
        g = grams(t)
        z = np.array([licence_model.weights[""][i] + sum(licence_model.weights[x][i] for x in g if x in licence_model.weights) for i in range(n)])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        out = set()
        if 1 - p[-1] >= licence_model.threshold:
            for f, t2 in licenses.TEMPLATES:
                share = len(grams(t2) & g) / len(grams(t2))
                if share == 1 or (f == licence_model.families[int(p[:-1].argmax())] and p[:-1].max() >= licence_model.threshold and share >= 0.75):
                    out.add(f)
        return out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: set(filter(None, r["licences"].split(","))) for r in licenses.licence_scan(docs, licence_model).collect()}
    hits = 0
    for r in docs.collect():
        want, lines = set(), (r["text"] or "").split("\n")
        for i, line in enumerate(lines):
            if line.strip(" "):
                want |= families(line)
                if grams(line) & set(licence_model.strong) and i + 1 < len(lines) and lines[i + 1].strip(" "):
                    want |= families(" ".join([line, lines[i + 1]] + ([lines[i + 2]] if i + 2 < len(lines) and lines[i + 2].strip(" ") else [])))
        hits += bool(want)
        assert got[r["doc_id"]] == want, r["doc_id"]
    assert hits > 0
