import random
from difflib import SequenceMatcher

import pytest
from loamwork.operators import lookup


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in sorted(set(keys))], "_key string")


@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.95])
def test_best_matches_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    stems = ["supplier#0000", "warehouse north ", "ab", "ünïcode ", "a long name that goes on and on with words "]
    right = [rng.choice(stems) + "".join(rng.choice("0123456789xyz") for _ in range(rng.randint(0, 9))) for _ in range(90)] + ["a", "aa", "aaa", "q"]

    def typo(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "é", "0"])
        return "".join(s) or "z"

    left = [typo(rng.choice(right)) for _ in range(90)] + ["aaaa", "zzz"]
    got = {(r["left_key"], r["right_key"], round(r["score"], 9)) for r in lookup.fuzzy_matches(frame(spark, left), frame(spark, right), threshold).collect()}
    expected = set()
    for x in set(left):
        score, key = max(((1.0 if x == y else SequenceMatcher(None, x, y).ratio(), y) for y in set(right)), key=lambda p: (p[0], [-ord(c) for c in p[1]] + [1]))
        best = min(y for y in set(right) if abs((1.0 if x == y else SequenceMatcher(None, x, y).ratio()) - score) < 1e-12)
        if score >= threshold:
            expected.add((x, best, round(score, 9)))
    assert got == expected


def test_candidates_grow_with_the_keys_not_their_square(spark):
    counts = {}
    for n in (250, 1000):
        codes = [f"supplier#{i * 7919 % 1_000_000_000:09d}" for i in range(1, n + 1)]
        typed = frame(spark, [c.replace("pp", "p") for c in codes])
        counts[n] = lookup.near_pairs(typed, frame(spark, codes)).count()
        assert counts[n] < 4 * n
    assert counts[1000] < 8 * counts[250]


def test_index_candidates_are_counted(spark):
    keys = [f"{a} item of the {b} kind, number {i}" for i, (a, b) in enumerate((x, y) for x in ("red", "blue", "quartz", "onyx", "jade") for y in ("first", "second", "third", "fourth"))]
    pairs = lookup.index_pairs(frame(spark, [k.upper().lower().replace("item", "itm") for k in keys]), frame(spark, keys), 0.95)
    assert pairs.count() < 0.5 * len(keys) ** 2


def test_rows_made_from_keys_are_never_broadcast(spark, tmp_path):
    """The files of keys are small; what deletions make of them is not."""
    frame(spark, [f"customer#{i:09d}" for i in range(2000)]).write.parquet(f"{tmp_path}/keys")
    keys = spark.read.parquet(f"{tmp_path}/keys")
    for most in (1, 2):
        plan = lookup.near_pairs(keys, keys, most)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_codes_meet_by_rare_stretches(spark, monkeypatch):
    """Codes of the same characters, one changed and one added, find their own without the index of characters."""
    counts, true = {}, {}
    for n in (100, 400):
        rng = random.Random(n)
        true[n] = ["supplier code " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)]
        counts[n] = lookup.stretch_pairs(frame(spark, ["supplier_" + c[9:] + "!" for c in true[n]]), frame(spark, true[n])).count()
        assert counts[n] < 2 * n
    monkeypatch.setattr(lookup, "index_pairs", None)
    found = lookup.fuzzy_matches(frame(spark, ["supplier_" + c[9:] + "!" for c in true[100]]), frame(spark, true[100]), 0.85).collect()
    assert sorted(r["right_key"] for r in found) == sorted(true[100]) and all(r["left_key"][9:-1] == r["right_key"][9:] for r in found)


@pytest.mark.parametrize("threshold", [0.85, 0.95])
def test_long_keys_equal_brute_force(spark, threshold):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcx ") for _ in range(n)).strip() + "z"
    right = [word(rng.randint(18, 60)) for _ in range(60)]
    right += [r[:k] + rng.choice("abcx") + r[k + 1 :] for r in right[:30] for k in [rng.randrange(len(r) - 1)]]

    def typo(s):
        for _ in range(rng.randint(1, 5)):
            i = rng.randrange(len(s) - 1)
            s = s[:i] + rng.choice(["", "x", "b", "q"]) + s[i + rng.randint(0, 1) :]
        return s

    left = {typo(rng.choice(right)) for _ in range(80)} - {""}
    expected = set()
    for x in left:
        score, key = min((-(1.0 if x == y else SequenceMatcher(None, x, y).ratio()), y) for y in set(right))
        if -score >= threshold:
            expected.add((x, key, round(-score, 9)))
    got = {(r["left_key"], r["right_key"], round(r["score"], 9)) for r in lookup.fuzzy_matches(frame(spark, left), frame(spark, right), threshold).collect()}
    assert got == expected
