import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import planned
from textlab.functions import scoring
from textlab.operators import embed, metrics
from textlab.plans.evaluate import evaluate

# Published test results: cells, accuracy, F1.
GOLDENS = {
    "bert-avg": (210, 144, 101, 329, 0.6875, 0.631578947368421),
    "bert-cls": (258, 170, 53, 303, 0.7155612244897959, 0.6982408660351827),
    "instructor": (252, 137, 59, 336, 0.75, 0.72),
    "sonar": (235, 150, 76, 323, 0.7117346938775511, 0.6752873563218391),
}
# Published rounded report of the sonar run.
SONAR = {"0": (0.81, 0.68, 0.74, 473), "1": (0.61, 0.76, 0.68, 311),
         "macro avg": (0.71, 0.72, 0.71, 784), "weighted avg": (0.73, 0.71, 0.71, 784)}


def cells(spark, tp, fp, fn, tn):
    counts = [(1, 1, tp), (0, 1, fp), (1, 0, fn), (0, 0, tn)]
    df = spark.createDataFrame(counts, "label int, pred int, n int")
    return df.select("label", "pred", F.explode(F.sequence(F.lit(1), "n"))).select("label", "pred")


@pytest.mark.parametrize("run", GOLDENS)
def test_goldens(spark, run):
    *table, accuracy, f1 = GOLDENS[run]
    df = cells(spark, *table)
    row = metrics.binary_scores(df).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == tuple(table)
    assert row["accuracy"] == pytest.approx(accuracy, abs=1e-12)
    assert row["f1"] == pytest.approx(f1, abs=1e-12)
    assert metrics.accuracy(df).first()[0] == pytest.approx(accuracy, abs=1e-12)


def test_report_golden(spark):
    rows = {r["class"]: r for r in metrics.classification_report(cells(spark, *GOLDENS["sonar"][:4])).collect()}
    for name, want in SONAR.items():
        r = rows[name]
        assert (round(r["precision"], 2), round(r["recall"], 2), round(r["f1"], 2), r["support"]) == want
    assert rows["accuracy"]["precision"] is None and round(rows["accuracy"]["f1"], 2) == 0.71


def test_zero_division(spark):
    df = spark.createDataFrame([(0, 2), (1, 2), (1, 1)], "label int, pred int")
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert (rows["0"]["precision"], rows["0"]["f1"]) == (0.0, 0.0)       # never predicted
    assert (rows["2"]["recall"], rows["2"]["support"]) == (0.0, 0)       # never present
    none = spark.createDataFrame([(0, 0)], "label int, pred int")
    assert metrics.binary_scores(none).first()["f1"] == 0.0


def test_class_weights_by_hand(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    got = {r["label"]: r["weight"] for r in metrics.class_weights(df).collect()}
    assert got == pytest.approx({0: 0.25, 1: 0.75})


def test_losses_by_hand(spark):
    rows = [(0, [0.5, -1.0, 2.0], 0), (2, [800.0, 0.0, -800.0], 1), (1, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "label int, logits array<double>, batch_id int")
    w = {0: 0.2, 1: 0.5, 2: 0.3}
    weights = spark.createDataFrame(list(w.items()), "label int, weight double")
    nll = [max(z) + math.log(sum(math.exp(v - max(z)) for v in z)) - z[y] for y, z, _ in rows]
    want = sum(w[y] * l for (y, _, _), l in zip(rows, nll)) / sum(w[y] for y, _, _ in rows)
    assert metrics.weighted_ce_loss(df, weights).first()[0] == pytest.approx(want)
    # a large weight table takes the shuffled join and gives the same
    assert evaluate(df.withColumn("pred", F.lit(0)), True, weights=weights).first()["loss"] == pytest.approx(want)
    term = scoring.nll_term("logits", "label")
    assert metrics.epoch_loss(df, term).first()[0] == pytest.approx(sum(nll) / 3)
    compat = ((nll[0] + nll[2]) / 2 + nll[1]) / 3
    assert metrics.epoch_loss(df, term, compat=True).first()[0] == pytest.approx(compat)


def test_bce_is_stable(spark):
    df = spark.createDataFrame([(1000.0, 0), (-1000.0, 1), (0.0, 1)], "z double, label int")
    assert metrics.bce_loss(df).first()[0] == pytest.approx((1000 + 1000 + math.log(2)) / 3)


def test_decisions(spark):
    df = spark.createDataFrame([(0.0, [1.0, 3.0, 3.0]), (0.1, [5.0, 5.0, 5.0]), (-0.1, [0.0, 1.0, 2.0])],
                               "z double, v array<double>")
    rows = df.select(scoring.predict_binary("z").alias("b"), scoring.predict_multiclass("v").alias("m"),
                     scoring.softmax_col("v").alias("p")).collect()
    assert [r["b"] for r in rows] == [0, 1, 0] and [r["m"] for r in rows] == [1, 0, 2]
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in rows)


@pytest.mark.parametrize("engine", ["native", "arrow", "auto"])
def test_head_equals_numpy(spark, sf, engine):
    rng = np.random.default_rng(0)
    shapes = [(16, 64), (8, 16), (3, 8)]
    mats = [(rng.normal(size=s), rng.normal(size=s[0])) for s in shapes]
    df = spark.read.parquet(f"{sf}/embeddings.parquet").limit(40)
    layers = [scoring.Layer.of(w.tolist(), b.tolist()) for w, b in mats]
    for r in df.withColumn("z", scoring.score_head("embedding", layers, engine)).collect():
        x = np.array(r["embedding"], dtype=float)
        for i, (w, b) in enumerate(mats):
            x = w @ x + b
            x = np.maximum(x, 0) if i < 2 else x
        assert np.allclose(r["z"], x)


def test_head_nulls_and_width(spark):
    layer = [scoring.Layer.of([[1.0, 2.0]], [0.5])]
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "i int, v array<double>")
    for engine in ("native", "arrow"):
        got = {r["i"]: r["z"] for r in df.select("i", scoring.score_head("v", layer, engine).alias("z")).collect()}
        assert got == {1: [3.5], 2: None}
    bad = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="width"):
        bad.select(scoring.score_head("v", layer, "native")).collect()


def test_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "a b A"), (2, "..."), (3, None)], "row_id long, text string")
    got = {r["row_id"]: r["embedding"] for r in embed.embed(df, width=16).collect()}
    assert sorted(x for x in got[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5], abs=1e-6)
    assert got[2] == [0.0] * 16 and got[3] is None
    assert "Python" not in planned(embed.embed(df)) and "Exchange" not in planned(embed.embed(df))


@pytest.mark.parametrize("width", [1, 7, 64, 100])
def test_hashing_encoder_counts_all_slots_at_once(spark, width):
    texts = ["", "...", "one", "a b A a_b É é 7 " * 30, " ".join(f"w{i % 211}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "row_id long, text string")
    out = embed.embed(df, width=width)
    assert "array_remove" not in planned(out)  # a pass over all words for every slot
    got = {r["row_id"]: r["embedding"] for r in out.collect()}
    assert got.pop(5) is None
    for i, v in got.items():
        want = [0.0] * width
        for w in re.findall(r"\w+", texts[i].lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width] += 1
        norm = sum(x * x for x in want) ** 0.5 or 1
        assert v == pytest.approx([x / norm for x in want], abs=1e-6)


def test_encoder_batches_and_nulls(spark):
    def factory():
        def encode(texts):
            assert 0 < len(texts) <= 3
            return [[float(len(t)), float(len(texts))] for t in texts]
        return encode

    df = spark.createDataFrame([(i, None if i == 4 else "x" * i) for i in range(10)], "row_id long, text string")
    got = {r["row_id"]: r["embedding"] for r in embed.embed(df.coalesce(1), factory, batch_size=3).collect()}
    assert got[4] is None and all(got[i][0] == i for i in range(10) if i != 4)
    with pytest.raises(ValueError):
        embed.embed(df, "no-such-encoder")


def test_profile_rejects_mixed_widths(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="widths differ"):
        embed.embedding_profile(df).collect()


def test_pool_mean_of_a_long_document(spark):
    df = spark.range(3000).select(F.lit(1).alias("doc_id"), (F.col("id") % 6).alias("layer"),
                                  F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    assert embed.pool_mean(df).first()["embedding"] == pytest.approx([1499.5, 1.0])
    last = embed.pool_mean(df, layer="layer", last_layers=4).first()["embedding"]
    assert last[0] == pytest.approx(np.mean([i for i in range(3000) if i % 6 >= 2]))


def test_pairing_is_by_key(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, label int")
    b = spark.createDataFrame([(2, 1), (1, 0)], "row_id long, pred int")
    assert metrics.accuracy(metrics.pair_predictions(a, b)).first()[0] == 1.0


def test_l1_leaves_biases_out(spark):
    df = spark.createDataFrame([([1.0, -2.0], False), ([9.0], True)], "w array<double>, is_bias boolean")
    assert metrics.l1_penalty(df, 0.5).first()[0] == 1.5
