import random

import pytest
from loamwork.llm.shared import WordTokenizer, default_tokenizer
from loamwork.llm.tokens import PieceCounter, piece_file_vocabulary, token_counts

from .helpers import TEXTS, empty_documents, odd_documents

models = pytest.importorskip("tokenizers.models")
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402


def library(vocabulary, unk, fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=unk, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
    return t


@pytest.mark.parametrize("seed", range(5))
def test_ties_fall_as_in_the_library(seed):
    rng = random.Random(seed)
    letters = "abcd"
    vocabulary = [("<unk>", 0.0)] + [(p, -float(rng.randint(1, 4))) for p in {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(25)}]
    counter, t = PieceCounter(vocabulary, 0, False), Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    words = ["".join(rng.choice(letters + "xy") for _ in range(rng.randint(1, 15))) for _ in range(500)]
    assert [counter.count(w) for w in words] == [len(e.ids) for e in t.encode_batch(words, add_special_tokens=False)]


def test_counts_equal_the_library_with_a_public_vocabulary(spark):
    path = default_tokenizer("piece_bpe_32k.model")
    vocabulary, unk = piece_file_vocabulary(path)
    t = library(vocabulary, unk, True)
    docs = odd_documents(spark)
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in token_counts(docs, path).collect())
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect() if "\x1c" not in (r["text"] or ""))
    assert [f for f in found if f[1] != 10] == [w for w in want if w[1] != 10]
    assert token_counts(empty_documents(spark), path).count() == 0


def test_word_tokenizer_equals_whole_texts():
    path = default_tokenizer()
    full, words = Tokenizer.from_file(path), WordTokenizer(path)
    rng = random.Random(2)
    alphabet = "aAbB.,!'’s éÉ́̌JjHTİıß漢 \n\t  \x1c0123<|endoftext|>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    import numpy as np

    kind = np.uint16 if words.code == "H" else np.uint32
    found = [np.frombuffer(x, kind).tolist() for x in words.encode([t.encode() for t in texts])]
    assert found == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_equal_the_library_with_no_row_left_out(spark, tmp_path):
    """Separators, very long words and a ``tokenizers`` Unigram file."""
    from loamwork.llm.tokens import MARKER

    rng = random.Random(5)
    letters = "abcdé漢" + MARKER
    vocabulary = [("<unk>", 0.0)] + sorted((p, -rng.random() * 5) for p in {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(80)})
    t = library(vocabulary, 0, False)
    path = str(tmp_path / "unigram.json")
    t.save(path)
    texts = ["a\x1cb", "ab\x1d\x1e cd\x1f", "a\x0bb\x0cc\x85d\xa0e f　g", "abcd" * 200 + " ab " + "abcd" * 200, "", None, " \x1c ", "".join(rng.choice(letters + " xyz\x1c") for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, path).collect()}
    assert found == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    with pytest.raises(ValueError):
        from loamwork.llm.tokens import unigram_file_vocabulary

        unigram_file_vocabulary(default_tokenizer())


def test_a_word_is_looked_up_once_a_batch():
    """Also one too long to be remembered; white space of all kinds, none and bytes that are no UTF-8 change nothing."""
    asked = []

    class Counting(WordTokenizer):
        def __missing__(self, word):
            asked.append(word)
            return super().__missing__(word)

    path = default_tokenizer()
    long, odd = b"ab" * 50, [b"", b" \t ", b" a\tb\x0bc\x0cd\r\n", b"\xff\xfe x", "é e\u0301 İ 中文\u3000x".encode(), b"x\x1cy"]
    words, alone = Counting(path), WordTokenizer(path)
    found = words.encode([long + b" " + long, *odd, b"A " + long])
    assert asked.count(long) == 1
    assert found == [alone[long] * 2, *(b"".join(alone[w] for w in alone._lower(t).split()) for t in odd), alone[b"a"] + alone[long]]
    assert words.encode([]) == []
