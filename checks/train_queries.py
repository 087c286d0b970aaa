"""Heads trained step by step: the weights after some steps, sessions, folds and halving."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.plan_queries import vectors
from checks.registry import query
from textlab.operators.metrics import class_weights, classification_report
from textlab.operators.sampling import Choice, LogUniform
from textlab.operators.split import TRAIN, VALIDATION, exact_split, stratified_kfold
from textlab.plans.config import Config
from textlab.plans.crossval import cross_validate, refit
from textlab.plans.evaluate import evaluate
from textlab.plans.fit import score
from textlab.plans.search import search_halving
from textlab.plans.session import run_session
from textlab.plans.train import Member, prepare, train
from textlab.sources.storage import fresh_path, materialize

STEPS, HIDDEN, RATE, L1, DECAY = 3, 3, 0.5, 1e-3, 1e-2
RELU = Config(multi=True, head="relu", opt="AdamW", h_dim=8, lr=0.02, l1=1e-5, weight_decay=1e-3,
              drop_rate=0.2, max_epochs=4)


def _start(member: Member):
    """First weights by a rule that SQL can follow."""
    i, j, c = np.arange(64), np.arange(HIDDEN), np.arange(4)
    hidden = ((7 * i[None, :] + 13 * j[:, None]) % 11 - 5) / 20
    out = ((5 * j[None, :] + 3 * c[:, None]) % 7 - 3) / 5
    return [(hidden, np.zeros(HIDDEN)), (out, np.zeros(4))]


def _step_sql(t: int) -> str:
    """Weights t + 1 from weights t: forward pass, class-weighted slopes, gradients with the
    L1 term, cut to norm 1, and a step of descent with decay."""
    return f"""a{t} AS MATERIALIZED (
  SELECT r, list(greatest(list_inner_product(x, w) + b, 0) ORDER BY j) AS a
  FROM v CROSS JOIN h{t} GROUP BY r),
e{t} AS (
  SELECT r, c, exp(z - max(z) OVER (PARTITION BY r)) AS e
  FROM (SELECT r, c, list_inner_product(a, w) + b AS z FROM a{t} CROSS JOIN o{t})),
s{t} AS MATERIALIZED (
  SELECT r, c, n.w / (SELECT sum(cw.w) FROM v JOIN cw USING (y))
    * (e / sum(e) OVER (PARTITION BY r) - CASE WHEN c = y THEN 1 ELSE 0 END) AS s
  FROM e{t} JOIN v USING (r) JOIN cw n USING (y)),
d{t} AS MATERIALIZED (
  SELECT r, j, CASE WHEN a[j + 1] > 0 THEN sum(s * w[j + 1]) ELSE 0 END AS s
  FROM s{t} JOIN o{t} USING (c) JOIN a{t} USING (r) CROSS JOIN range({HIDDEN}) g(j) GROUP BY r, j, a),
g{t} AS MATERIALIZED (
  SELECT 1 AS layer, c AS unit, i, sum(s * a[i + 1]) AS g
  FROM s{t} JOIN a{t} USING (r) CROSS JOIN range({HIDDEN}) g(i) GROUP BY c, i
  UNION ALL SELECT 1, c, -1, sum(s) FROM s{t} GROUP BY c
  UNION ALL SELECT 0, j, i, sum(s * x[i + 1])
  FROM d{t} JOIN v USING (r) CROSS JOIN range(64) g(i) GROUP BY j, i
  UNION ALL SELECT 0, j, -1, sum(s) FROM d{t} GROUP BY j),
p{t} AS MATERIALIZED (
  SELECT layer, unit, i, value, g + CASE WHEN i >= 0 THEN {L1} * sign(value) ELSE 0 END AS g
  FROM w{t} JOIN g{t} USING (layer, unit, i)),
w{t + 1} AS MATERIALIZED (
  SELECT layer, unit, i, value - {RATE} * (g * least(1, 1 / (
    sqrt((SELECT sum(q.g * q.g) FROM p{t} q)) + 1e-6)) + {DECAY} * value) AS value FROM p{t}),
{_lists_sql(t + 1)}"""


def _lists_sql(t: int) -> str:
    return ", ".join(f"""{name}{t} AS MATERIALIZED (
  SELECT unit AS {unit}, list(value ORDER BY i) FILTER (i >= 0) AS w, sum(value) FILTER (i < 0) AS b
  FROM w{t} WHERE layer = {layer} GROUP BY unit)""" for layer, name, unit in ((0, "h", "j"), (1, "o", "c")))


STEPS_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id AS r, CAST(embedding AS DOUBLE[]) AS x, label % 4 AS y FROM embeddings WHERE vec_id % 5 <> 0),
k AS (SELECT y, 1.0 / count(*) AS w FROM v GROUP BY y),
cw AS MATERIALIZED (SELECT y, w / (SELECT sum(w) FROM k) AS w FROM k),
w0 AS MATERIALIZED (
  SELECT 0 AS layer, j AS unit, i, CASE WHEN i < 0 THEN 0 ELSE ((7 * i + 13 * j) % 11 - 5) / 20 END AS value
  FROM range({HIDDEN}) a(j) CROSS JOIN range(-1, 64) b(i)
  UNION ALL SELECT 1, c, j, CASE WHEN j < 0 THEN 0 ELSE ((5 * j + 3 * c) % 7 - 3) / 5 END
  FROM range(4) a(c) CROSS JOIN range(-1, {HIDDEN}) b(j)),
{_lists_sql(0)},
{",".join(_step_sql(t) for t in range(STEPS))}
SELECT CAST(layer AS INTEGER) AS layer, CAST(unit AS INTEGER) AS unit, CAST(i AS INTEGER) AS input,
  round(value, 7) + 0 AS value FROM w{STEPS}
"""


@query("train_relu_steps", STEPS_SQL)
def train_relu_steps(spark, sf):
    """Weights of a ReLU head after some steps of descent on the rows outside of a fold;
    input -1 is the bias."""
    data = vectors(spark, sf, 4).withColumn("fold", (F.col("row_id") % 5).cast("int"))
    config = Config(multi=True, head="relu", opt="SGD", h_dim=HIDDEN, lr=RATE, l1=L1, weight_decay=DECAY,
                    drop_rate=0.0, max_epochs=STEPS)
    done = train(prepare(data, "fold"), [Member("steps", config, 0)], start=_start).learners[0]
    rows = [(d, unit, i, round(float(value), 7) + 0.0)
            for d, (w, b) in enumerate(done.layers)
            for unit in range(len(b))
            for i, value in [(-1, b[unit]), *enumerate(w[unit])]]
    return spark.createDataFrame(rows, "layer int, unit int, input int, value double")


@query("fit_relu")
def fit_relu(spark, sf):
    """Report of a ReLU head trained on all rows."""
    data = vectors(spark, sf, 4)
    return classification_report(score(refit(data, RELU, 6), data, multiclass=True))


@query("session_relu", "SELECT true AS loss_same, true AS f1_same, true AS resumed_same")
def session_relu(spark, sf):
    """The logged loss and F1 of a session's best head against a separate evaluation, and
    the log of a session that was cut off and resumed against that of a whole one."""
    data = materialize(exact_split(vectors(spark, sf, 4), 0.8), "vectors")
    whole = run_session(data, RELU, "relu")
    path = fresh_path(spark, "session")
    run_session(data, RELU.with_(max_epochs=2), "relu", path=path)
    resumed = run_session(data, RELU, "relu", path=path)
    val = data.where(F.col("split") == VALIDATION)
    train_rows = data.where(F.col("split") == TRAIN)
    found = evaluate(score(whole.model, val, multiclass=True), True, weights=class_weights(train_rows))
    logged = whole.epochs.where(F.col("epoch") == whole.best_epoch).first()
    return found.select(
        (F.abs(F.col("loss") - logged["loss"]) < 1e-9).alias("loss_same"),
        (F.abs(F.col("f1") - logged["f1"]) < 1e-9).alias("f1_same"),
        F.lit(_log(whole) == _log(resumed)).alias("resumed_same"))


def _log(session) -> list[tuple]:
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r)
            for r in session.epochs.orderBy("epoch").collect()]


@query("cross_validate_relu", """
SELECT CAST(i AS INTEGER) AS fold, true AS same, true AS one_pass_an_epoch FROM range(3) g(i)""")
def cross_validate_relu(spark, sf):
    """Folds trained side by side against each fold trained alone."""
    data = materialize(vectors(spark, sf, 4), "vectors")
    config = RELU.with_(k=3, max_epochs=3)
    folds = cross_validate(data, config).folds
    table = prepare(stratified_kfold(data, 3, config.seed), "fold")
    members = [Member(f"fold{i}", config, i) for i in range(3)]
    alone = [train(table, [m]).learners[0] for m in members]
    rows = [(i, sum(r[3] for r in x.log) / len(x.log)) for i, x in enumerate(alone)]
    passes = train(table, members).passes
    longest = max(x.epoch for x in alone)
    return folds.join(spark.createDataFrame(rows, "fold int, f1 double"), "fold").select(
        "fold", (F.abs(F.col("avg_f1") - F.col("f1")) < 1e-9).alias("same"),
        F.lit(passes == longest).alias("one_pass_an_epoch"))


@query("search_halving", """
SELECT * FROM (VALUES (2, 3::BIGINT), (4, 1::BIGINT), (6, 2::BIGINT)) v(epochs, trials)""")
def halving(spark, sf):
    """How many epochs the six trials of a halving search were trained."""
    data = materialize(vectors(spark, sf, 2), "vectors")
    space = {"L1": LogUniform(1e-6, 5e-4), "LR": LogUniform(1e-3, 1e-1), "H_DIM": Choice((4, 8))}
    config = Config(head="relu", opt="AdamW", samples=6, max_epochs=6)
    found = search_halving(data, config, space=space, grace=2)
    reached = found.reports.groupBy("trial").agg(F.max("iteration").alias("epochs"))
    return reached.groupBy("epochs").agg(F.count(F.lit(1)).alias("trials"))
