import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import runs
from textlab.llm.queries import op11_runs


def slow_runs(words, least=24, repeats=3):
    """Every period on its own: stretches in which words a period apart are equal."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def fast_runs(docs, **options):
    codes, starts, _ = runs.word_codes([" ".join(d).encode() for d in docs])
    rows = runs.runs_of(codes, starts, **options).tolist()
    return [[tuple(r[1:]) for r in rows if r[0] == i] for i in range(len(docs))]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_by_brute_force(data):
    rng = random.Random(data.draw(st.integers(0, 10**9)))
    docs = []
    for _ in range(rng.randint(1, 4)):
        letters = rng.choice([1, 2, 3, 5, 50])
        words = [str(rng.randrange(letters)) for _ in range(rng.choice([0, 5, 24, 60, 150]))]
        for _ in range(rng.randint(0, 3)):
            block = [str(rng.randrange(letters)) for _ in range(rng.randint(1, 40))]
            at = rng.randint(0, len(words))
            words[at:at] = block * rng.randint(1, 5) + block[: rng.randint(0, len(block))]
        docs.append(words)
    assert fast_runs(docs) == [slow_runs(d) for d in docs]
    assert fast_runs(docs, least=6) == [slow_runs(d, 6) for d in docs]
    assert fast_runs(docs, repeats=4) == [slow_runs(d, repeats=4) for d in docs]


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    assert fast_runs([list(b)]) == [slow_runs(list(b))]


@pytest.mark.parametrize("words", [
    ["a"] * 200_000, ["a", "b"] * 100_000, [str(i % 7_001) for i in range(100_000)]])
def test_long_texts(words):
    q = len(set(words))
    assert fast_runs([words]) == [[(0, len(words), q)]]


def test_a_long_text_is_split_piece_by_piece(monkeypatch):
    monkeypatch.setattr(runs, "_TOGETHER", 7)
    codes, starts, words = runs.word_codes([b" ab\tcd  ef\x0bgh ab" * 3, b"", b"\x0c", b"x" * 50])
    assert starts.tolist() == [0, 15, 15, 15, 16]
    assert [words[i] for i in codes[:5]] == [b"ab", b"cd", b"ef", b"gh", b"ab"]


def test_fewer_repeats_than_three_are_refused():
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(0, np.int64), np.zeros(1, np.int64), repeats=2)


def slow_row(doc_id, text):
    import hashlib
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    from fractions import Fraction
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_by_brute_force(spark, documents, parquet_dir):
    rng = random.Random(3)
    rows = [(i, " \n".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))))
            for i in range(300)]
    rows += [(301, None), (302, ""), (303, " \t\n"), (304, "é ü " * 20), (None, "x " * 30),
             (305, "a b " * 12 + "c " + "d e f " * 8), (305, "a b " * 12 + "c " + "d e f " * 8),
             (306, "    " * 15), (307, "word " * 23), (308, "w" * 5000)]
    documents(rows, extra=True).write.parquet(f"{parquet_dir}/documents.parquet")
    got = [tuple(r) for r in op11_runs(spark, parquet_dir).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted((slow_row(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 5


def test_columns_and_empty_table(spark, documents):
    docs = documents([(1, "a " * 30)], extra=True).selectExpr("*", "7 AS runs", "8 AS best_run")
    out = runs.collapse_runs(docs)
    assert out.columns == [c for c in docs.columns if c not in ("runs", "best_run")] + [
        "runs", "best_run", "collapsed"]
    row = out.first()
    assert (row["fp"], row["collapsed"]) == (1, "a")
    assert [tuple(r) for r in row["runs"]] == [(0, 30, 1)]
    assert runs.collapse_runs(docs.limit(0)).count() == 0
