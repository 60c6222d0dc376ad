import random

import numpy as np
import pytest
import xxhash
from loamwork.llm.components import connected_components
from loamwork.llm.simhash import _links_within_two, fingerprint_components, near_duplicates
from pyspark.sql import functions as F

from .helpers import WORD, ascii_lower, empty_documents, odd_documents


def fingerprint(text):
    w = WORD.findall(ascii_lower(text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(12)]
    texts = base + [b + " tail" * (i % 2) for i, b in enumerate(base * 3)] + [None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = [fingerprint(t) for t in texts]
    want = components(len(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 2)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in fingerprint_components(docs).collect()}
    assert found == {i: (f"{f[i]:016x}", want[i]) for i in range(len(f))}


@pytest.mark.parametrize("common", [2, 32])
def test_links_connect_what_two_bits_connect(spark, common, monkeypatch):
    import loamwork.llm.simhash as s

    monkeypatch.setattr(s, "COMMON", common)
    rng = random.Random(common)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c for c in centres} | {rng.choice(centres) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 3))}) for _ in range(120)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(nodes.withColumnRenamed("fp", "node"), _links_within_two(nodes)).collect()}
    want = components(len(values), lambda a, b: ((values[a] ^ values[b]) & (2**64 - 1)).bit_count() <= 2)
    assert roots == {values[i]: values[w] for i, w in enumerate(want)}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert fingerprint_components(docs).count() == docs.count() and near_duplicates(docs).count() == docs.count()
    assert fingerprint_components(empty_documents(spark)).count() == 0 and near_duplicates(empty_documents(spark)).count() == 0


def test_near_duplicates_have_recall_and_no_false_links(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for g in range(60):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(40 if g == 0 else 2):
            copy = list(base)
            for _ in range(max(1, len(base) // 100)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    want = components(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["group_id"] for r in near_duplicates(docs).collect()}
    same = sum(found[i] == w for i, w in enumerate(want))
    assert same >= 0.95 * len(want)
    assert all(want[i] == want[g] for i, g in found.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    nodes = spark.range(0, 1400).withColumnRenamed("id", "node")
    roots = {r["node"]: r["root"] for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(201)} == {0} and {roots[1000 + i] for i in range(300)} == {1000} and roots[500] == 500
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(nodes, none).where("node <> root").count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def groups_and_brute_force(spark, texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in texts]
    want = components(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = {r["doc_id"]: r["group_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return found, dict(enumerate(want))


def test_near_duplicates_find_block_edits_and_short_texts(spark):
    """Text appended, cut off or replaced at an end, at similarities on both sides of 0.8."""
    rng = random.Random(21)
    texts = []
    for n in [*[200] * 12, *[60] * 12, *[14] * 12, 1, 3, 5, 6, 9]:
        base = words(rng, n)
        shingles = max(1, n - 4)
        for edit in (shingles // 4, shingles // 4 + 1, shingles // 5, shingles // 9):
            texts += [" ".join(base), " ".join(base + words(rng, edit)), " ".join(base[: n - edit]), " ".join(words(rng, edit) + base), " ".join(base[: n - edit] + words(rng, edit))][:: rng.choice([1, 2, 3])]
            base = words(rng, n)
    found, want = groups_and_brute_force(spark, [*texts, "", "  ", "\n"])
    assert found == want


@pytest.mark.parametrize("common", [2, 6])
def test_near_duplicates_of_drifting_copies(spark, common, monkeypatch):
    """Chains in which only neighbours are alike, all in crowded shingles."""
    import loamwork.llm.simhash as s

    monkeypatch.setattr(s, "COMMON", common)
    rng = random.Random(common)
    texts = []
    for _ in range(3):
        line = words(rng, 260)
        for i in range(0, 150, 9):
            texts += [" ".join(line[i : i + 100]), " ".join(line[i : i + 100] + words(rng, 2))]
    rng.shuffle(texts)
    found, want = groups_and_brute_force(spark, texts)
    assert found == want and len(set(want.values())) == 3


def test_simhash_groups_come_first_and_are_not_compared_again(spark, monkeypatch):
    """Texts that the fingerprints link make no candidates of the exact check; it finds what is further apart."""
    from loamwork.llm import simhash

    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    near = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in (0, 899)]
    far = " ".join(words[:820])
    texts = [" ".join(words), *near, far, " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))]
    prints = [simhash.simhash64(t.encode()) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 2 for p in prints[1:3]) and all((p ^ prints[3]).bit_count() > 2 for p in prints[:3])
    asked, verified = [], simhash._verified

    def seen(pairs, *more):
        asked.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "_verified", seen)
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in found} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert asked[:2] == [2, 3]


def test_sketches_tell_unlike_texts_of_usual_length_apart():
    from loamwork.llm.simhash import FOLD, parity_bits

    rng = np.random.default_rng(1)
    bits = [parity_bits(rng.integers(0, 1 << 63, 330, dtype=np.uint64), FOLD) for _ in range(40)]
    differ = [sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b)) for i, a in enumerate(bits) for b in bits[:i]]
    assert min(differ) > 660 * 0.2 / 1.8


def test_crowded_shingles_come_late_in_prefixes_however_few_texts_are_sampled(spark, monkeypatch):
    from loamwork.llm import simhash

    monkeypatch.setattr(simhash, "_frequent", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    rng = random.Random(11)
    line = "this line is in all of them and crowds"
    docs = spark.createDataFrame([(i, " ".join(words(rng, 30)) + " " + line) for i in range(400)], "doc_id long, text string")
    common = set(simhash.shingle_hashes(line.encode(), 5).view(np.int64).tolist())
    assert len(common) == 5 and not any(common & set(r["keys"]) for r in simhash._prefixes(docs, 5, 0.8).collect())


def test_members_of_crowded_shingles_are_only_where_partners_may_be(spark):
    """Of one size: once each. Of two sizes that may be alike: in two places each. The other bands hold nobody."""
    from loamwork.llm import simhash

    def banded(*sizes):
        rows = [(7, i, 0, n, i) for i, n in enumerate(sizes)]
        crowd = spark.createDataFrame(rows, "key long, node long, pos int, size long, root long").withColumn("fold", F.array(F.lit(0).cast("long")))
        return {(r["low"], r["high"]): r["n"] for r in simhash._banded(crowd, 0.8).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).collect()}

    assert list(banded(*[396] * 50).values()) == [50]
    assert sorted(banded(*[396] * 50, *[350] * 40).values()) == [40, 50, 90]
    assert sorted(banded(*[396] * 50, *[200] * 40).values()) == [40, 50]
