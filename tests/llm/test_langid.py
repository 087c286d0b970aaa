import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import langid
from textlab.llm.queries import op2_langid


def slow_positions(w, data):
    """Distribution at every byte, one step at a time with plain loops over gates."""
    h = w["recf"].shape[1]
    states = {}
    for d, order in (("f", range(len(data))), ("b", reversed(range(len(data))))):
        s = np.zeros(h)
        for t in order:
            x = w["in" + d][:, data[t]] + w["bias" + d]
            r = w["rec" + d] @ s
            z = 1 / (1 + np.exp(-(x[:h] + r[:h])))
            reset = 1 / (1 + np.exp(-(x[h : 2 * h] + r[h : 2 * h])))
            new = np.tanh(x[2 * h :] + reset * (r[2 * h :] + w["new" + d]))
            s = (1 - z) * new + z * s
            states[d, t] = s
    out = []
    for t in range(len(data)):
        e = np.exp(w["out"] @ np.concatenate([states["f", t], states["b", t]]) + w["bias"])
        out.append(e / e.sum())
    return np.array(out)


def test_pooled_by_brute_force():
    rng = np.random.default_rng(1)
    model = langid.Model(list("abc"), langid._start(3, 5, rng))
    texts = [b"", b"x", bytes(rng.integers(0, 256, 63)), bytes(rng.integers(0, 256, 64)),
             bytes(rng.integers(0, 256, 150))]
    got = langid.pooled(model, texts)
    assert got[0] == pytest.approx([1 / 3] * 3)
    for text, p in zip(texts[1:], got[1:]):
        rows = [text[i : i + langid.STEPS] for i in range(0, len(text), langid.STEPS)]
        want = np.concatenate([slow_positions(model.weights, r) for r in rows]).mean(axis=0)
        assert p == pytest.approx(want, abs=1e-5)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid._start(3, 4, rng).items()}
    codes = rng.integers(0, 256, (7, 5))
    live = np.arange(7)[:, None] < np.array([7, 3, 5, 1, 7])[None]
    labels = np.array([0, 1, 2, 1, 0])
    _, g = langid._gradients(w, codes, live, labels)
    for k, v in w.items():
        for _ in range(3):
            i = tuple(int(rng.integers(0, s)) for s in v.shape)
            if k.startswith("in"):
                i = (i[0], int(codes[0, 0]))
            old, e, losses = v[i], 1e-2, []
            for x in (old + e, old - e):
                v[i] = x
                losses.append(langid._gradients(w, codes, live, labels)[0])
            v[i] = old
            assert g[k][i] == pytest.approx((losses[0] - losses[1]) / 2 / e, abs=1e-4)


@pytest.fixture(scope="module")
def small_model():
    rng = random.Random(4)
    def text(parts):
        return " ".join(rng.choices(parts, k=60)).encode()
    texts = [text(["das", "und", "nicht", "ein"]) for _ in range(40)]
    texts += [text(["les", "une", "est", "pas"]) for _ in range(40)]
    return langid.train(texts, ["de"] * 40 + ["fr"] * 40, rounds=120, batch=32)


def test_odd_rows(spark, documents, small_model):
    rows = [(1, "das ist nicht ein"), (2, "est pas les une"), (3, None), (4, ""), (5, "12 %%"),
            (None, "und " * 50_000), (1, "das ist nicht ein")]
    df = documents(rows, extra=True).selectExpr("*", "'q' AS score")
    got = langid.predict_languages(df, small_model)
    assert got.columns == [*df.columns[:-1], "lang_pred", "score"]
    out = {r.doc_id: r for r in got.collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["de", "fr", "und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in out.values()) and got.count() == len(rows)
    assert langid.predict_languages(df.limit(0), small_model).count() == 0


def test_nothing_to_learn_from(spark, documents):
    model = langid.learn(documents([(1, None)]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert model.languages == []
    got = langid.predict_languages(documents([(1, "words")]), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_langid(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    out = both[both["held_out"]]
    assert 0.1 < len(out) / len(both) < 0.3
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_windows_lie_over_the_whole_text(spark):
    texts = ["", "short", "x" * 64, "".join(chr(33 + i % 90) for i in range(5000)), "é" * 200, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", langid.windows_of(F.col("t"), 8).alias("w")).collect())
    assert [len(got[i]) for i in range(6)] == [0, 1, 1, 8, 7, 0]
    assert bytes(got[1][0]) == b"short" and all(len(w) == 64 for i in (2, 3, 4) for w in got[i])
    raw = texts[3].encode()
    assert raw.startswith(bytes(got[3][0])) and raw.endswith(bytes(got[3][-1]))


def test_more_languages_than_rows(spark, documents):
    docs = documents([(i, f"text number {i}") for i in range(900)]).withColumn(
        "lang", F.concat(F.lit("l"), (F.col("doc_id") % 300).cast("string")))
    model = langid.learn(docs, rows=100, rounds=1)
    left = {f"l{i % 300}" for i in range(900) if zlib.crc32(str(i).encode()) % 5}
    assert set(model.languages) == left


def test_columns_of_any_name(spark, documents):
    docs = documents([(1, "abc"), (2, None)]).selectExpr("*", "1 AS _p", "2 AS p", "3 AS letters", "4 AS row")
    model = langid.train([b"abc", b"xyz"], ["a", "b"], rounds=1)
    out = langid.predict_languages(docs, model)
    assert out.columns == docs.columns + ["lang_pred", "score"]
    assert [tuple(r)[5:9] for r in out.collect()] == [(1, 2, 3, 4)] * 2
