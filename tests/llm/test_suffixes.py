import collections
import hashlib
import random

import numpy as np
import pytest
from loamwork.llm.suffixes import chosen_positions, common_prefix, merge_runs, remove_repeats
from pyspark.sql import functions as F

from .helpers import empty_documents, odd_documents


def brute(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def found(df, **options):
    r = remove_repeats(df.select("doc_id", "text"), **options).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, r))


@pytest.mark.parametrize("options", [{}, {"common": 3, "receiver_entries": 40, "batch_bytes": 2000}])
@pytest.mark.parametrize("length", [20, 60])
def test_equals_brute_force(spark, options, length):
    rng = random.Random(length)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(8)]
    texts = ["".join(rng.choice(parts)[rng.randint(0, 90) : rng.randint(90, 300)] for _ in range(rng.randint(0, 5))) for _ in range(50)]
    texts += ["ab" * 200, "x" * 300, None, "", "é" * 100, texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(df, length=length, **options) == sorted(brute([(t or "").encode() for t in texts], length))


def test_odd_rows_and_extra_columns(spark):
    docs = odd_documents(spark)
    assert found(docs, length=20) == sorted(brute([(r["text"] or "").encode() for r in docs.collect()], 20))
    kept = remove_repeats(docs, length=20, as_text=True)
    assert kept.columns[:-4] == [c for c in docs.columns if c != "text"] and kept.count() == docs.count()
    assert remove_repeats(empty_documents(spark)).count() == 0


def test_merge_keeps_order_and_common_prefixes():
    rng = random.Random(1)
    runs = []
    for _ in range(7):
        words = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40)))
        runs.append([(w, common_prefix(words[i - 1], w) if i else 0, None) for i, w in enumerate(words)])
    merged = list(merge_runs([iter(r) for r in runs]))
    want = sorted(w for r in runs for w, _, _ in r)
    assert [m[0] for m in merged] == want
    assert [m[1] for m in merged] == [common_prefix(a, b) for a, b in zip([b"", *want], want)]


def test_equal_windows_choose_equal_places():
    rng = np.random.default_rng(5)
    a, b = rng.integers(97, 100, 500, dtype=np.uint8), rng.integers(97, 100, 500, dtype=np.uint8)
    b[300:400] = a[100:200]
    buf, starts, ends = np.r_[a, b], np.array([0, 500]), np.array([500, 1000])
    at, _ = chosen_positions(buf, starts, ends, 60, 34)
    assert {p - 100 for p in at if 100 <= p <= 200 - 34} & {p - 800 for p in at if 800 <= p <= 900 - 34}
