import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import chunk_bpe
from textlab.llm.queries import op12_chunk_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = ["'s", "'", "'ll", "'LL", "'re", "'ve", "'r", "'v", "l", "d", " '", " ", "  ", "\n", "\r\n",
          "\t", "the", " the", "été", "1", "½", "...", "<|endoftext|>", "\xa0", "　", "日本", "😀",
          "x" * 90, "́", "\x1c", "\U0003134b", "\U0001e6c0", "՘", "\0", "a\0", "\x07", "abcdef\x07", "abcdefg", "abcdefgh"]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return chunk_bpe.Ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


KINDS = np.frombuffer(chunk_bpe.character_kinds(), np.uint8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(codec="utf-8")),
                         max_size=25).map("".join), max_size=5))
def test_as_the_library(ranks, library, texts):
    raw, cuts, _, first = chunk_bpe.split_texts(texts, KINDS)
    ids, begin = chunk_bpe.encode_words(chunk_bpe.Words(ranks), raw, cuts, first)
    for text, a, b in zip(texts, begin, begin[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(text), repr(text)
    assert chunk_bpe.decode_texts(ranks, ids, begin) == [t.encode() for t in texts]


@pytest.mark.parametrize("word", ["a" * 3000, "ab" * 2000, "=" * 5001, "日" * 700, "\0" * 40, "\n" * 300])
def test_long_words(ranks, library, word):
    ids, sizes = ranks.encode([b"x", word.encode(), b"\n", b"yz"])
    want = [library.encode_ordinary(w) for w in ("x", word, "\n", "yz")]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_memory_of_words_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "_MEMO_WORDS", 3)
    known = chunk_bpe.Words(ranks)
    for words in ([b"abc", b"def"], [b"abc", b"xyzzy"], [b"q" * 100, b"def", b"\n", b"a", b"b", b"c", b"d"], [b"abc"]):
        ids, sizes = known.encode(words)
        want, counts = ranks.encode(words)
        assert ids.tolist() == want.tolist() and sizes.tolist() == counts.tolist()
        assert len(known.seen) <= 3


def test_words_whose_numbers_mix_to_the_same_stand_alone(monkeypatch):
    words = [b"one", b"two", b"one", b"a longer word than that", b"two", b"", b"fifteen letters"]
    cuts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    for unique in (np.unique, lambda x, **k: (x[:1], np.zeros(1, int), np.zeros(len(x), int))):
        monkeypatch.setattr(chunk_bpe.np, "unique", unique)
        found, place = chunk_bpe._distinct(b"".join(words), cuts)
        assert [found[i] for i in place] == words
    monkeypatch.undo()


def texts_of(rng):
    return [None, "", " ", "a" * 400, "'" * 50 + "s", " " * 300, " " * 299 + "x", "don't " * 40,
            "\n" * 45 + "é" * 77 + "1" * 90 + "don't", "x" * 39 + "'re" + "y" * 80, "日本 " * 60,
            *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 120))) for _ in range(40)),
            "word " * 30, "word " * 30]


@pytest.mark.parametrize("stride, overlap", [(40, 3), (40, 20), (64, 64), (100_000, 512)])
def test_chunks_of_any_size(spark, documents, library, stride, overlap):
    rows = list(enumerate(texts_of(random.Random(stride)))) + [(3, "a" * 400), (None, "b c" * 30)]
    docs = documents(rows, extra=True).selectExpr("*", "1 AS key", "2 AS chunk", "3 AS ids", "4 AS p")
    out = chunk_bpe.encode_documents(docs, PATH, stride=stride, overlap=overlap)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["n_tokens", "ids", "decoded"]
    got = sorted((r["doc_id"] or -1, r["ids"], bytes(r["decoded"]).decode(), r["n_tokens"], r["key"])
                 for r in out.collect())
    want = sorted((i or -1, ids := library.encode_ordinary(t or ""), t or "", len(ids), 1) for i, t in rows)
    assert got == want


def test_query(spark, documents, parquet_dir, library, monkeypatch):
    rows = list(enumerate(texts_of(random.Random(5)))) + [(900, "one two  three\n" * 9000)]
    documents(rows).write.parquet(f"{parquet_dir}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(tuple(r) for r in op12_chunk_bpe(spark, parquet_dir).collect()) == sorted(want)


def test_empty_table_and_bad_overlap(spark, documents):
    docs = documents([(1, "a")])
    assert chunk_bpe.encode_documents(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        chunk_bpe.encode_documents(docs, PATH, stride=10, overlap=11)
