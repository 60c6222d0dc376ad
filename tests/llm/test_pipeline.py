import hashlib
import zlib

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from loamwork.llm import quality, shared
from loamwork.llm.shared import default_tokenizer, materialize
from pyspark.sql import functions as F

from ..conftest import SF
from .helpers import empty_documents, odd_documents
from .test_decontaminate import brute as contaminated
from .test_suffixes import brute as repeats

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in cp.STAGES:
        new = materialize(f(spark, docs, SF), "test-stage")
        out.append((name, docs, new))
        docs = new
    return {n: (a, b) for n, a, b in out}


def test_stages_keep_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert before.dtypes == after.dtypes and after.count() <= before.count()


def test_quality_stage_takes_what_scores_well(spark, stages):
    before, after = stages["quality"]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in quality.score(before, model).where("predicted = 1").select("doc_id").collect()}


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = stages["near_duplicates"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r[0] for r in after.select("doc_id").collect()} == {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_repeated_strings_go(stages):
    before, after = stages["repeated_strings"]
    a, b = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, after))
    ids = sorted(a)
    for i, want in zip(ids, repeats([a[i].encode() for i in ids], 200)):
        if want[1] == 0:
            assert b[i] == a[i]
        else:
            left, kept = len(b[i].encode()), want[0] - want[1]
            assert kept - 6 * want[2] <= left <= kept  # of a character that is cut at an end of a span, up to three bytes go too
            assert left < kept or hashlib.sha256(b[i].encode()).hexdigest() == want[3]
            assert ("�" in b[i]) <= ("�" in a[i])


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    left = {r[0] for r in after.select("doc_id").collect()}
    assert all(contaminated([t], bench, 10)[0][4] == (d not in left) for d, t in rows.items())


def test_packing_covers_what_is_left(stages):
    """Every id of every document that is left lies in one piece, and every sequence is filled without a gap."""
    before, after = stages["packing"]
    tok = tokenizers.Tokenizer.from_file(default_tokenizer())
    ids = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in before.collect()}
    by_doc, by_sequence = {d: [] for d in ids}, {}
    for r in after.collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[d]))
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_odd_tables(spark):
    for name, f in cp.STAGES:
        assert f(spark, empty_documents(spark), SF).count() == 0, name
    odd = odd_documents(spark)
    for name, f in cp.STAGES[:-1]:
        out = f(spark, odd, SF)
        assert out.columns == odd.columns, name
        out.count()


def test_stages_hold_few_texts_at_a_time(spark):
    """A task of 40 MB of texts gets them in batches of some 4 MB, whichever stage is called."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 1000 + 0 * F.col("id").cast("int")).alias("text"))
    before = {k: spark.conf.get(k) for k in cp.BATCHES}
    for name, f in cp.STAGES:
        for k in cp.BATCHES:
            spark.conf.unset(k)
        f(spark, empty_documents(spark), SF)
        assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 5 << 20, name
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    for k, v in before.items():
        spark.conf.set(k, v)


def test_tasks_without_a_tokenizer_let_the_words_of_others_go():
    shared.word_tokenizer(default_tokenizer()).encode([b"some words"])
    list(shared.tidy_with_words(lambda batches: batches)(iter([])))
    assert shared._tokenizers
    list(shared.tidy(lambda batches: batches)(iter([])))
    assert not shared._tokenizers


def test_run(spark):
    assert cp.run(spark, SF).count() > 0 and len(cp.STAGES) == 5
