import hashlib
import random
import re
from collections import Counter

import pytest

from textlab.llm import substring


def slow(texts, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    starts = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if starts[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), len(gone), " ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def texts_of(rng, window):
    shared = [" ".join(rng.choices("abcdefg", k=n)) for n in (window - 1, window, window + 1, 3 * window)]
    texts = [None, "", " \n ", "one", "x " * (4 * window)]
    for _ in range(40):
        parts = [" ".join(rng.choices("hijklmnop", k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), " ".join(rng.choices("qrstué", k=rng.randint(0, 9)))]
        texts.append("\t \n".join(parts))
    return texts + texts[10:14] + ["  " + (texts[20] or "").replace(" ", "\n")]


@pytest.mark.parametrize("window, period, cover", [(7, 7, (0, 1, 3)), (35, 21, substring.COVER)])
def test_by_brute_force(spark, documents, window, period, cover):
    texts = texts_of(random.Random(window), window)
    df = documents(list(enumerate(texts)), extra=True)
    got = substring.remove_repeats(df, window=window, period=period, cover=cover, block_bytes=300)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "n_words"]
    for i, (n, removed, kept) in enumerate(slow(texts, window)):
        r = rows[i]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, kept)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.text == texts[i]


def test_stage_form(spark, documents):
    long = " ".join(f"w{i}" for i in range(40))
    df = documents([(1, "a  b\n" + long), (2, long + " c"), (3, "  as  is "), (None, None)])
    out = substring.without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: ("a b", 3), 2: ("c", 1), 3: ("  as  is ", 9), None: (None, 0)}


def test_empty_table(spark, documents):
    df = documents([(1, "a")]).limit(0)
    assert substring.remove_repeats(df).count() == 0
    assert substring.without_repeats(df).columns == df.columns


def test_cover_is_checked(spark, documents):
    with pytest.raises(ValueError):
        substring.remove_repeats(documents([(1, "a")]), cover=(0, 1))


def test_words_whose_running_sums_collide(spark, documents):
    """Thue-Morse words and their complements have equal polynomial sums for every base."""
    t = "0"
    while len(t) < 4096:
        t += t.translate(str.maketrans("01", "10"))
    common = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{common} {t.translate(str.maketrans('01', 'ab'))}"),
            (2, f"{common} {t.translate(str.maketrans('01', 'ba'))}")]
    out = substring.remove_repeats(documents(rows)).collect()
    assert [r["n_removed"] for r in out] == [0, 0]
    out = substring.remove_repeats(documents([*rows, (3, rows[0][1])])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 35), (2, 0), (3, 35)]
