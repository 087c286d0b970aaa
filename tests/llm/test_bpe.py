import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlab.llm import bpe
from textlab.llm.queries import op6_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder(tmp_path_factory):
    with open(PATH, encoding="utf-8") as f:
        import json
        merges = bpe.Merges(json.load(f))
    words = [b"the", b" the", b" them", b"ing", b" sing", b" \xc3\xa9t\xc3\xa9", b"12", b"\n", b" a"]
    path = tmp_path_factory.mktemp("lexicon") / "words.bin"
    path.write_bytes(bpe.lexicon_bytes(words, merges))
    return bpe.Coder(merges, bpe.Lexicon(str(path)))


def same(coder, library, texts):
    for text, ids in zip(texts, coder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


PIECES = ["'s", "'", "'ll", "'LL", "s", " ", "  ", "\n", "\r\n", "\t", "the", " the", "été", "1", "½",
          "...", "<|endoftext|>", "<|endof", " ", " ", "日本", "😀", "x" * 90, "́", "\x1c"]


def test_pieces(coder, library):
    rng = random.Random(2)
    same(coder, library, ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(3000)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(coder, library, texts):
    same(coder, library, texts)


def test_long_texts(coder, library):
    same(coder, library, ["ab" * 40_000, " the" * 300_000, "", "\n" * 5000])


def test_automaton_is_minimal_and_ranks_words():
    words = sorted({a + b + c for a in (b"un", b"re", b"") for b in (b"do", b"tie", b"wind")
                    for c in (b"", b"s", b"ing")})
    parts = bpe.compile_lexicon(words)
    width = len(parts["next"]) // len(parts["ends"])
    # Equal rests share states: far fewer than the letters of all words.
    assert len(parts["ends"]) < 25 < sum(map(len, words))
    for rank, word in enumerate(words):
        state, before = int(parts["start"][0]), 0
        for b in word:
            arc = state * width + parts["classes"][b]
            before, state = before + parts["skip"][arc], parts["next"][arc]
        assert parts["ends"][state] and before == rank


@pytest.mark.parametrize("size", [0, 5, 1000])
def test_documents(spark, documents, library, size):
    rows = [(1, None), (2, ""), (3, "the end'll\n 12"), (None, "été <|endoftext|>x"), (3, "the end'll\n 12")]
    df = documents(rows, extra=True).selectExpr("*", "'k' AS ids", "0 AS n_tokens")
    got = bpe.encode_documents(df, PATH, lexicon_words=size)
    out = got.collect()
    assert len(out) == 5 and got.columns[:8] == df.columns[:8]
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, list(r.ids)) == (len(want), want)
        assert r.decoded == (r.text or "")
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_query_by_the_library(spark, tables, library):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    rows = {r.doc_id: r for r in op6_bpe(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_word_counts_cover_all_texts(spark, documents):
    df = documents([(i, "a b c a") for i in range(50)] + [(99, None)])
    got = {bytes(r.word): r.n for r in bpe.word_counts(df, "text").collect()}
    assert got == {b"a": 50, b" b": 50, b" c": 50, b" a": 50}


def test_many_special_tokens_take_linear_time(coder, library):
    text = "<|endoftext|>a" * 40_000
    assert len(coder.encode([text])[0]) == 80_000
    same(coder, library, ["<|endoftext|>" * 3, "x<|endoftext|><|endof", ""])


def test_a_level_larger_than_the_lexicon_is_split(spark, documents, monkeypatch):
    sizes = []
    made = bpe.lexicon_bytes
    monkeypatch.setattr(bpe, "lexicon_bytes", lambda words, m: (sizes.append(len(words)), made(words, m))[1])
    rows = [(i, f"w{i} " * 3) for i in range(60)]
    out = bpe.encode_documents(documents(rows), PATH, lexicon_words=20)
    assert out.where("decoded = text").count() == 60 and sizes == [20]
