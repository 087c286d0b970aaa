import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.functions import head
from textlab.functions.scoring import Layer
from textlab.operators.logs import rung_survivors
from textlab.operators.sampling import Choice, LogUniform
from textlab.operators.split import exact_split
from textlab.plans import train as T
from textlab.plans.config import Config
from textlab.plans.crossval import cross_validate, refit
from textlab.plans.evaluate import evaluate
from textlab.plans.fit import score
from textlab.plans.search import search, search_halving
from textlab.plans.session import run_session
from textlab.sources.storage import fresh_path, materialize

RELU = Config(head="relu", opt="AdamW", h_dim=5, lr=0.05, l1=1e-4, weight_decay=1e-2, drop_rate=0.3, max_epochs=5)


@pytest.fixture(scope="module")
def data(spark):
    """500 vectors of three classes, in an order that has nothing to do with them."""
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1.5, (3, 6))
    rows = []
    for i in range(500):
        y = int(rng.choice(3, p=[0.6, 0.3, 0.1]))
        rows.append((i, [float(v) for v in rng.normal(size=6) + middles[y]], y, i % 4))
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label int, fold int")
    return materialize(df.repartition(7), "toy")


def binary(df):
    return df.withColumn("label", (F.col("label") > 0).cast("int"))


def loop(rows, config, holdout, start, batches=1):
    """The same training in one process, row by row, each formula on its own."""
    d = len(rows[0]["x"])
    layers = [(w.copy(), b.copy()) for w, b in start]
    first = [[np.zeros_like(p) for p in pair] for pair in layers]
    second = [[np.zeros_like(p) for p in pair] for pair in layers]
    inside = [r for r in rows if r["fold"] != holdout]
    counts = np.array([sum(r["y"] == c for r in inside) for c in range(config.classes)], float)
    weight = 1 / np.maximum(counts, 1) * (counts > 0)
    weight = weight / weight.sum() if config.multi else np.ones(2)
    step, rate, losses = 0, config.lr, []
    best, bad = -math.inf, 0
    for epoch in range(config.max_epochs):
        order = np.random.default_rng([config.seed, epoch]).permutation(batches)
        for at, batch in enumerate(order):
            salt = (config.seed * 1_000_003 + epoch) * 1_000_003 + at
            total, norm = 0.0, 0.0
            grads = [[np.zeros_like(p) for p in pair] for pair in layers]
            for r in inside:
                if batches > 1 and r["key"] % batches != batch:
                    continue
                a, kept = [np.array(r["x"])], None
                for k, (w, b) in enumerate(layers):
                    z = w @ a[-1] + b
                    if k < len(layers) - 1:
                        z = np.where(z > 0, z, 0)
                        if k == len(layers) - 2 and config.drop_rate:
                            kept = head.keep_mask(np.array([r["key"]]), len(z), config.drop_rate, salt)[0]
                            z = z * kept
                    a.append(z)
                out, cw = a[-1], weight[r["y"]]
                if config.multi:
                    p = np.exp(out) / np.exp(out).sum()
                    total += -cw * math.log(p[r["y"]])
                    slope = cw * (p - np.eye(config.classes)[r["y"]])
                else:
                    p = 1 / (1 + math.exp(-out[0]))
                    total += -math.log(p if r["y"] else 1 - p)
                    slope = np.array([p - r["y"]])
                norm += cw
                for k in range(len(layers) - 1, -1, -1):
                    grads[k][0] += np.outer(slope, a[k])
                    grads[k][1] += slope
                    if k:
                        slope = (layers[k][0].T @ slope) * (a[k] > 0)
                        if kept is not None and k == len(layers) - 1:
                            slope = slope * kept
            step += 1
            losses.append(total / norm + config.l1 * sum(np.abs(w).sum() for w, _ in layers))
            for k, (w, _) in enumerate(layers):
                grads[k][0] = grads[k][0] / norm + config.l1 * np.sign(w)
                grads[k][1] = grads[k][1] / norm
            size = math.sqrt(sum((g**2).sum() for pair in grads for g in pair))
            scale = min(1.0, 1.0 / (size + 1e-6))
            for k, pair in enumerate(layers):
                new = []
                for j, p in enumerate(pair):
                    g = grads[k][j] * scale
                    if config.opt == "SGD":
                        new.append(p - rate * (g + config.weight_decay * p))
                        continue
                    first[k][j] = 0.9 * first[k][j] + 0.1 * g
                    second[k][j] = 0.999 * second[k][j] + 0.001 * g * g
                    m, v = first[k][j] / (1 - 0.9**step), second[k][j] / (1 - 0.999**step)
                    new.append(p - rate * config.weight_decay * p - rate * m / (np.sqrt(v) + 1e-8))
                layers[k] = tuple(new)
        if holdout is not None:  # the plateau rule on the F1
            f1 = slow_f1(layers, [r for r in rows if r["fold"] == holdout], config)
            if best == -math.inf or f1 > best * (1 + 1e-4):
                best, bad = f1, 0
            else:
                bad += 1
                if bad > config.patience:
                    rate, bad = rate * 0.1, 0
    return layers, losses


def slow_f1(layers, rows, config):
    model = T.TrainedHead(tuple(Layer.of(w.tolist(), b.tolist()) for w, b in layers))
    hits = {c: [0, 0, 0] for c in range(config.classes)}
    for r in rows:
        x = np.array(r["x"])
        for k, layer in enumerate(model.layers):
            x = np.array(layer.weights) @ x + layer.bias
            x = np.maximum(x, 0) if k < len(model.layers) - 1 else x
        p = int(np.argmax(x)) if config.multi else int(x[0] > 0)
        hits[r["y"]][0] += 1
        hits[p][1] += 1
        hits[p][2] += p == r["y"]
    f1 = {c: 2 * h / (s + p) if s + p else 0.0 for c, (s, p, h) in hits.items()}
    return sum(f1[c] * hits[c][0] for c in f1) / len(rows) if config.multi else f1[1]


@pytest.mark.parametrize("config, batches", [
    (RELU, 1),
    (RELU.with_(multi=True, redux=4), 1),
    (RELU.with_(multi=True, opt="SGD", lr=0.3, drop_rate=0.0), 3),
    (RELU.with_(head="linear", patience=0, lr=0.5, max_epochs=8), 1),
])
def test_same_path_as_one_process(data, config, batches):
    df = data if config.multi else binary(data)
    table = T.prepare(df, "fold", batches=batches)
    rows = [r.asDict() for r in table.rows.collect()]
    done = T.train(table, [T.Member("m", config, 1)], stop_early=False).learners[0]
    start = head.start_layers(T.widths(config, 6), config.seed)
    layers, losses = loop(rows, config, 1, start, batches)
    for (w, b), (v, c) in zip(done.layers, layers):
        assert np.allclose(w, v, atol=1e-9) and np.allclose(b, c, atol=1e-9)
    per_epoch = np.array(losses).reshape(config.max_epochs, batches).mean(axis=1)
    assert np.allclose([r[5] for r in done.log], per_epoch)
    if config.patience == 0:
        assert done.rate < config.lr  # the plateau rule took part


def test_layout_does_not_matter(data):
    config = RELU.with_(multi=True, max_epochs=3)
    logs = [T.train(T.prepare(df, "fold"), [T.Member("m", config, 0)]).learners[0].log
            for df in (data, data.repartition(2).sortWithinPartitions(F.desc("row_id")))]
    assert np.allclose(logs[0], logs[1])


def test_sums_are_added_in_a_tree(data, monkeypatch):
    config = RELU.with_(multi=True, max_epochs=2)
    table = T.prepare(data.repartition(30), "fold")
    wide = T.train(table, [T.Member("m", config, 0)]).learners[0].log
    monkeypatch.setattr(T, "FAN_IN", 3)
    many = T.Table(table.rows.repartition(30), table.width, 30, 1, table.counts)
    assert np.allclose(T.train(many, [T.Member("m", config, 0)]).learners[0].log, wide)


def test_log_is_that_of_a_separate_evaluation(data):
    split = exact_split(binary(data))
    s = run_session(split, RELU)
    val = split.where("split = 'val'")
    m = evaluate(score(s.model, val)).first()
    logged = s.epochs.where(F.col("epoch") == s.best_epoch).first()
    assert [logged[c] for c in ("loss", "accuracy", "f1")] == pytest.approx([m["loss"], m["accuracy"], m["f1"]])
    assert s.epochs.columns[-2:] == ["rate", "train_loss"] and s.avg_f1 > 0.5


@pytest.mark.parametrize("head_kind", ["linear", "relu"])
def test_early_stop_spends_lives(data, head_kind):
    config = RELU.with_(head=head_kind, lr=0.0, max_epochs=9)  # never better, never worse: lives return
    assert run_session(binary(data), config).last_epoch == 9
    learner = T.Learner.new(T.Member("m", RELU.with_(max_epochs=9), 0), head.start_layers([2, 2, 1], 1))
    for f1 in (0.5, 0.6, 0.4, 0.4, 0.6, 0.1, 0.2, 0.3):
        assert learner.live
        learner.end_epoch(T.Metrics(0.0, 0.0, f1), 0.0, True)
    assert not learner.live and (learner.best_epoch, learner.epoch) == (4, 8)


@pytest.mark.parametrize("cut", [1, 2, 4])
def test_cut_off_session_ends_the_same(spark, data, cut, monkeypatch):
    whole = T.train(T.prepare(data, "fold"), [T.Member("m", RELU.with_(multi=True), 1)]).learners[0]
    path, saved = fresh_path(spark, "state"), T._save

    def dies(spark, path, epoch, learners):
        if epoch == cut:
            raise RuntimeError("driver lost")
        saved(spark, path, epoch, learners)

    members, table = [T.Member("m", RELU.with_(multi=True), 1)], T.prepare(data, "fold")
    monkeypatch.setattr(T, "_save", dies)
    with pytest.raises(RuntimeError):
        T.train(table, members, path=path)
    monkeypatch.undo()
    seen = []
    monkeypatch.setattr(T, "_epoch", lambda *a, go=T._epoch: (seen.append(a[3]), go(*a)))
    again = T.train(table, members, path=path).learners[0]
    assert seen[0] == cut and np.allclose(again.log, whole.log)
    assert all(np.allclose(w, v) for (w, _), (v, _) in zip(again.best_layers, whole.best_layers))
    with pytest.raises(ValueError, match="other settings"):
        T.train(table, [T.Member("m", RELU.with_(multi=True, l1=0.5), 1)], path=path)


def test_folds_side_by_side(data):
    config = RELU.with_(multi=True, k=4, max_epochs=3)
    table = T.prepare(data, "fold")
    members = [T.Member(f"fold{i}", config, i) for i in range(4)]
    together = T.train(table, members)
    assert together.passes == max(x.epoch for x in together.learners)
    for member, x in zip(members, together.learners):
        alone = T.train(table, [member]).learners[0]
        assert np.allclose(x.log, alone.log)
    cv = cross_validate(data, config)
    assert cv.folds.count() == 4 and cv.best.epochs.count() == cv.best.last_epoch


def test_a_failed_member_leaves_the_others(data):
    config = RELU.with_(multi=True, max_epochs=2)
    bad = T.Member("bad", config.with_(opt="SGD", l1=1e308), 1)
    done = T.train(T.prepare(data, "fold"), [bad, T.Member("good", config, 0)])
    assert [x.failed for x in done.learners] == [True, False]
    assert len(done.learners[1].log) == 2


def test_refit_follows_a_cosine(data):
    config = RELU.with_(multi=True, max_epochs=6)
    done = T.train(T.prepare(data), [T.Member("all", config)]).learners[0]
    want = [config.lr] + [1e-6 + (config.lr - 1e-6) * (1 + math.cos(math.pi * e / 6)) / 2 for e in (1, 2, 3)]
    assert [r[4] for r in done.log][:4] == pytest.approx(want)
    assert done.log[-1][1] < done.log[0][1]
    again = refit(data, config, 6)
    assert all(np.allclose(a.weights, b.weights) for a, b in zip(again.layers, done.model().layers))


def test_halving(spark, data):
    space = {"L1": LogUniform(1e-6, 1e-3), "LR": LogUniform(1e-4, 1e-1), "H_DIM": Choice((2, 6))}
    config = RELU.with_(samples=7, max_epochs=8)
    full = search(binary(data), config, space=space)
    path = fresh_path(spark, "halving")
    half = search_halving(binary(data), config, space=space, grace=2, path=path)
    reports = half.reports.collect()
    assert len(reports) == 7 * 2 + 4 * 2 + 2 * 4 < full.reports.count() == 56
    whole = {(r["trial"], r["iteration"]): r["f1"] for r in full.reports.collect()}
    assert all(whole[r["trial"], r["iteration"]] == pytest.approx(r["f1"]) for r in reports)
    kept = {(r["trial"], r["iteration"]) for r in rung_survivors(
        half.reports, grace=2, cap=8, seed=config.seed).collect()}
    for rung, after in ((2, 4), (4, 8)):
        assert {t for t, i in kept if i == rung} == {r["trial"] for r in reports if r["iteration"] == after}
    again = search_halving(binary(data), config, space=space, grace=2, path=path)
    assert sorted(again.reports.collect()) == sorted(reports)


def test_odd_rows(spark, data):
    extra = spark.createDataFrame(
        [(900, None, 1, 0), (901, [1.0] * 6, None, 0), (902, [1.0] * 6, 1, None)], data.schema)
    table = T.prepare(data.unionByName(extra), "fold")
    assert sum(table.counts.values()) == 501 and table.counts[-1, 1] == 1
    config = RELU.with_(multi=True, max_epochs=1)
    for bad, what in (((903, [1.0] * 5, 1, 0), "needs 6"), ((903, [1.0] * 6, 7, 1), "labels must")):
        broken = T.prepare(data.unionByName(spark.createDataFrame([bad], data.schema)), "fold")
        if what == "labels must":
            broken.counts.pop((1, 7))
        with pytest.raises(Exception, match=what):
            T.train(broken, [T.Member("m", config, 0)])
    with pytest.raises(ValueError, match="no row"):
        T.prepare(data.limit(0))
    with pytest.raises(ValueError, match="head must"):
        T.train(table, [T.Member("m", Config(head="mlp"), 0)])
    with pytest.raises(ValueError, match="path"):
        run_session(data, Config(), path="x")
