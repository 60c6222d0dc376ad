import hashlib
import re

import numpy as np
from loamwork.llm.decontaminate import build_index, contamination, phrase_positions, proximity_positions, words_of

from .helpers import ascii_lower, empty_documents, odd_documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items, width):
    windows = {}
    for name, text in items:
        w = WORDS.findall(ascii_lower(text or ""))
        for p in [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else []:
            windows.setdefault(p, set()).add(str(name))
    out = []
    for t in texts:
        w, hit, own = WORDS.findall(ascii_lower(t or "")), set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    own |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [(1, "The cat sat on the mat, and looked"), (2, "word"), (10, None), (11, ""), (3, "a b c d e f g h i j k"), (4, "again again again again again"), (5, "Ærø ß 漢字 かな"), (None, "sat on the mat"), (2, "cat sat")]
COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_equals_brute_force(spark):
    docs, bench = odd_documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([r["text"] for r in docs.collect()], [i for i in ITEMS if i[0] is not None], 4)
    for options in ({}, {"block_bytes": 100}):
        assert sorted(tuple(r[c] for c in COLUMNS) for r in contamination(docs, bench, 4, **options).collect()) == want
    assert contamination(empty_documents(spark), bench).count() == 0
    assert not contamination(docs, bench.limit(0)).where("contaminated").count()


def test_phrases_and_proximity():
    words = words_of(b"the red fox saw the blue fox; red blue")
    lists = {}
    for i, w in enumerate(words):
        lists.setdefault(w, []).append(i)
    lists = {k: np.array(v) for k, v in lists.items()}
    assert phrase_positions(lists, (b"the", b"blue")).tolist() == [4]
    assert phrase_positions(lists, (b"blue", b"the")).tolist() == []
    assert proximity_positions(lists, [b"red", b"saw"], 2).tolist() == [3]
    assert proximity_positions(lists, [b"red", b"nothing"], 5).tolist() == []


def test_index_holds_all_terms(spark):
    postings, documents = build_index(odd_documents(spark))
    assert postings.where("term = 'moon'").count() >= 1 and documents.count() >= 1


def near_by_brute_force(texts, items, width, slop):
    """Ids of items with a window whose terms all stand within ``slop`` words of its longest term."""
    out = []
    for w in [WORDS.findall(ascii_lower(t or "")) for t in texts]:
        own = set()
        for name, text in items:
            it = WORDS.findall(ascii_lower(text or ""))
            for p in [it[i : i + width] for i in range(len(it) - width + 1)] if len(it) >= width else [it] if it else []:
                key = sorted(p, key=lambda x: (-len(x.encode()), x.encode()))[0]
                if any(w[i] == key and all(x in w[max(0, i - slop) : i + slop + 1] for x in p) for i in range(len(w))):
                    own.add(str(name))
        out.append(sorted(own))
    return out


def test_proximity_matches(spark):
    """Words inserted, swapped and turned round: no exact window is left, and the passage is still found."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = passage.split()
    texts = [
        passage, " ".join(w[:5] + ["added"] + w[5:]), " ".join([w[1], w[0], *w[2:]]), " ".join(w[::-1]), " filler ".join(w[:4]) + " far " * 30 + " ".join(w[4:]), " ".join(w[:9]), "alpha kappa", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, passage), (2, "alpha kappa"), (3, "nothing of it")], "item_id long, text string")
    for options in ({}, {"block_bytes": 70}):
        got = {r["doc_id"]: (r["contaminated"], r["near_items"]) for r in contamination(docs, bench, 10, **options).collect()}
        assert {d: n for d, (_, n) in got.items()} == {i: ",".join(x) for i, x in enumerate(near_by_brute_force(texts, [(r[0], r[1]) for r in bench.collect()], 10, 15))}
        assert got[0] == (True, "1,2") and got[1] == (False, "1,2") and got[2][0] is False and "1" in got[3][1] and got[4] == (False, "") and got[5][1] == ""


def test_a_stored_index_answers_later_benchmarks(spark):
    from loamwork.llm.decontaminate import match_items

    docs = odd_documents(spark)
    index = build_index(docs)
    for items in ([("a", b"cat sat on the mat")], [("b", b"again again"), ("c", b"word")], []):
        stored = sorted((r["doc_id"] or -1, r["n_words"], r["items"], r["near"]) for r in match_items(docs, items, 4, index=index).collect())
        fresh = sorted((r["doc_id"] or -1, r["n_words"], r["items"], r["near"]) for r in match_items(docs, items, 4).collect())
        assert stored == fresh and len(stored) == docs.count()
