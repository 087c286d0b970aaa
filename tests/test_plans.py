import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators.sampling import Choice, LogUniform
from textlab.plans.config import Config
from textlab.plans.crossval import cross_validate
from textlab.plans.evaluate import evaluate_file
from textlab.plans.fit import fit_linear, fit_mlp, head_layers, score
from textlab.plans.search import run_experiment, search
from textlab.plans.session import run_session, split_counts
from textlab.sources.sinks import load_model, save_run
from textlab.sources.storage import materialize

SPACE = {"WEIGHT_DECAY": LogUniform(1e-4, 1e-2), "H_DIM": Choice((4, 8))}


@pytest.fixture(scope="module")
def data(spark):
    """Two classes, apart along the first coordinate; a third of the mass in class 1."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        y = int(i % 3 == 0)
        rows.append((i, [float(v) for v in rng.normal(size=4) + [3.0 * y, 0, 0, 0]], y))
    return materialize(spark.createDataFrame(rows, "row_id long, embedding array<float>, label int"), "toy")


def test_linear_learns_and_reloads(spark, data, tmp_path):
    from pyspark.ml import PipelineModel

    model = fit_linear(data, weight_decay=1e-3)
    scored = score(model, data)
    assert scored.where("label = pred").count() > 105
    assert scored.select((F.col("z") > 0).cast("int").alias("p"), "pred").where("p <> pred").count() == 0
    path = save_run(str(tmp_path / "run"), PipelineModel([model]))
    again = score(load_model(path).stages[0], data)
    assert again.select("row_id", "pred").exceptAll(scored.select("row_id", "pred")).count() == 0


def test_l1_zeroes_weights(data):
    assert np.count_nonzero(fit_linear(data, l1=0.2).coefficients.toArray()) < 4


def test_multiclass_weights_lift_the_rare_class(data):
    plain = fit_linear(data, l1=0.0, weight_decay=0.3)
    weighted = fit_linear(data, multiclass=True, weight_decay=0.3)
    rare = lambda m, multi: score(m, data, multiclass=multi).where("pred = 1").count()
    assert rare(weighted, True) >= rare(plain, False)


def test_mlp_continues_from_weights(data):
    first = fit_mlp(data, hidden=(4,), max_iter=2)
    more = fit_mlp(data, hidden=(4,), max_iter=20, start=first.weights)
    assert more.getLayers() == [4, 4, 2]
    assert score(more, data).where("label = pred").count() > 100


def test_head_layers_score_the_same(data):
    from textlab.functions.scoring import score_head

    model = fit_linear(data, multiclass=True)
    rows = score(model, data, multiclass=True).withColumn("own", score_head("embedding", head_layers(model))).collect()
    assert all(np.allclose(r["logits"], r["own"]) for r in rows)


@pytest.mark.parametrize("head", ["linear", "mlp"])
def test_session(data, head):
    s = run_session(data, Config(head=head, h_dim=4, max_epochs=3, weight_decay=1e-3))
    log = s.epochs.collect()
    assert s.avg_f1 == pytest.approx(sum(r["f1"] for r in log) / len(log))
    assert s.last_epoch == log[-1]["epoch"] + 1 and 0 <= s.best_epoch < s.last_epoch
    assert s.test is None


def test_session_tests_the_best_model(data):
    s = run_session(data, Config(multi=True, max_epochs=5, weight_decay=1e-3), test=data)
    assert s.test["accuracy"] > 0.85 and s.test["loss"] > 0
    with pytest.raises(ValueError):
        run_session(data, Config(head="tree"))


def test_split_counts(data):
    from textlab.operators.split import exact_split

    train, val = split_counts(exact_split(data))
    assert sum(r["count"] for r in train.collect()) == 96 and sum(r["count"] for r in val.collect()) == 24


def test_cross_validation_skips_failed_folds(data):
    def flaky(table, config, run_id):
        if run_id == "fold1":
            raise RuntimeError("lost")
        return run_session(table, config, run_id)

    cv = cross_validate(data, Config(k=3, max_epochs=5, weight_decay=1e-3), session=flaky)
    rows = cv.folds.orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [0, 2]
    assert cv.best_fold == max(rows, key=lambda r: (r["avg_f1"], -r["fold"]))["fold"]
    assert cv.summary(Config(k=3), "r").first()["completed_folds"] == 2

    def broken(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="no fold completed"):
        cross_validate(data, Config(k=2), session=broken)


def test_search_reports_every_trial(data):
    found = search(data, Config(samples=3, max_epochs=4), space=SPACE)
    assert found.trials.count() == 3
    top = found.ranked(k=1).first()
    assert found.best.weight_decay == pytest.approx(top["config/WEIGHT_DECAY"])
    assert found.best.h_dim == top["config/H_DIM"]


def test_evaluate_file_needs_an_encoder(spark):
    with pytest.raises(TypeError):
        evaluate_file(spark, None, "x.csv")


def test_experiment_writes_results(spark, tmp_path):
    rows = [(i, f"{'good fine' if i % 2 else 'bad awful'} day {i} #x", i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "row_id long, text string, label int")
    out = str(tmp_path / "exp")
    done = run_experiment(train, train, Config(samples=2, k=2, max_epochs=5), {"hash": "hashing"}, out=out, space=SPACE)
    assert done["hash"].metrics.first()["test_accuracy"] > 0.9
    path = f"{out}/hash/test_metrics"
    part = next(p for p in os.listdir(path) if p.endswith(".json"))
    with open(f"{path}/{part}") as f:
        saved = json.loads(f.read())
    assert saved["EMB_MODEL"] == "hash" and saved["test_f1"] == done["hash"].metrics.first()["test_f1"]


def test_config_round_trip():
    assert Config.of({"H_DIM": 8, "MULTI": True, "UNKNOWN": 1}) == Config(h_dim=8, multi=True)
    assert Config.of(Config(k=3).record()) == Config(k=3)
