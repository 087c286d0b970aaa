"""One training session: fit on a split, validate per epoch, stop early, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from textlab.operators.explore import count_labels
from textlab.operators.logs import MIN_LIVES
from textlab.operators.metrics import class_weights
from textlab.operators.small import localized
from textlab.operators.split import TRAIN, VALIDATION, exact_split
from textlab.plans.config import Config
from textlab.plans.evaluate import evaluate
from textlab.plans.fit import fit_linear, fit_mlp, score
from textlab.plans.train import Learner, Member, TrainedHead, prepare, train

LOG_SCHEMA = "run_id string, epoch int, loss double, accuracy double, f1 double, patience int"
# Heads trained step by step log their rate and training loss as well.
STEP_LOG_SCHEMA = f"{LOG_SCHEMA}, rate double, train_loss double"
# Solver steps between two validations of a perceptron.
STEPS_PER_EPOCH = 5


@dataclass(frozen=True)
class Session:
    """Best model, its log (one row per validated epoch), the mean metrics, and the
    metrics row of the test table when one was given."""

    model: Model | TrainedHead
    epochs: DataFrame
    avg_acc: float
    avg_f1: float
    last_epoch: int
    best_epoch: int
    test: Row | None = None


def split_counts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label counts of the training and the validation side."""
    return (
        count_labels(df.where(F.col("split") == TRAIN)),
        count_labels(df.where(F.col("split") == VALIDATION)),
    )


def session_of(learner: Learner, spark, test: Row | None = None) -> Session:
    """The session that a learner went through; without an epoch this raises."""
    if learner.failed or not learner.log:
        raise RuntimeError(f"{learner.member.name} has no finite loss")
    name, patience = learner.member.name, learner.member.config.patience
    rows = [(name, *r[:4], patience, *r[4:]) for r in learner.log]
    n = len(learner.log)
    return Session(
        learner.model(), spark.createDataFrame(rows, STEP_LOG_SCHEMA),
        avg_acc=sum(r[2] for r in learner.log) / n, avg_f1=sum(r[3] for r in learner.log) / n,
        last_epoch=learner.epoch, best_epoch=learner.best_epoch, test=test)


def _first_order_session(df, config, run_id, stop_early, test, path) -> Session:
    held = df.withColumn("_held", F.when(F.col("split") == VALIDATION, 0).when(F.col("split") == TRAIN, 1))
    table = prepare(held.where("_held IS NOT NULL"), "_held", batches=config.steps, seed=config.seed)
    done = train(table, [Member(run_id, config, 0)], stop_early, path=path).learners[0]
    weights = _weights(df.where(F.col("split") == TRAIN)) if config.multi else None
    return session_of(done, df.sparkSession, None if test is None else _validate(
        done.model(), test, config, weights))


def _validate(model: Model, df: DataFrame, config: Config, weights: DataFrame | None) -> Row:
    scored = score(model, df, multiclass=config.multi)
    return evaluate(scored, config.multi, weights=weights).first()


def _weights(df: DataFrame) -> DataFrame:
    table = class_weights(df)
    local = localized(table)
    return table if local is None else local


def fit_once(
    df: DataFrame, config: Config, epochs: int, weights: DataFrame | None = None
) -> Model | TrainedHead:
    """Fit without validation for a given number of epochs."""
    if config.first_order:
        member = Member("refit", config.with_(max_epochs=epochs))
        table = prepare(df, batches=config.steps, seed=config.seed)
        return train(table, [member]).learners[0].model()
    if config.head == "linear":
        return fit_linear(
            df, multiclass=config.multi, l1=config.l1, weight_decay=config.weight_decay,
            max_iter=epochs, weights=weights,
        )
    return _mlp(df, config, epochs * STEPS_PER_EPOCH)


def _mlp(df: DataFrame, config: Config, steps: int, start=None, width: int | None = None):
    hidden = (config.h_dim,) if config.redux is None else (config.redux, config.h_dim)
    return fit_mlp(
        df, width=width, hidden=hidden, classes=config.classes, max_iter=steps,
        seed=config.seed, block_size=config.batch_size,
        sgd_rate=config.lr if config.opt == "SGD" else None, start=start,
    )


def run_session(
    df: DataFrame,
    config: Config,
    run_id: str = "session",
    stop_early: bool = True,
    test: DataFrame | None = None,
    path: str | None = None,
) -> Session:
    """Train on an embedded table ``row_id, embedding, label`` and validate.

    A ``split`` column (``train``/``val``) is used when present, else an exact random
    split is drawn. The table should be stored: every solver step reads it.

    With AdamW or SGD a linear or ReLU head is trained step by step, validated after every
    epoch, with a falling rate and early stop; given a ``path`` under shared storage, its
    state is kept there after every epoch, and the session goes on from it if started
    again. With MLlib's solver a linear head is convex and validated once, at its last
    step; a perceptron is validated after every epoch and continues from its weights. Only
    one metrics row per epoch reaches the driver.
    """
    if config.head not in ("linear", "mlp", "relu"):
        raise ValueError(f"head must be 'linear', 'mlp' or 'relu', not {config.head!r}")
    if path is not None and not config.first_order:
        raise ValueError("a path keeps the state of heads trained with AdamW or SGD")
    table = df if "split" in df.columns else exact_split(df, config.split, config.seed)
    if config.first_order:
        return _first_order_session(table, config, run_id, stop_early, test, path)
    training = table.where(F.col("split") == TRAIN)
    val = table.where(F.col("split") == VALIDATION)
    weights = _weights(training) if config.multi else None
    best_epoch = 0
    log: list[tuple] = []
    best: Model | None = None
    if config.head == "linear":
        best = fit_once(training, config, config.max_epochs, weights)
        m = _validate(best, val, config, weights)
        last = max(best.summary.totalIterations, 1) - 1
        log.append((run_id, last, m["loss"], m["accuracy"], m["f1"], config.patience))
        best_epoch = last
    else:
        width = training.select(F.size("embedding")).first()[0]
        lives, best_f1, state = max(MIN_LIVES, config.patience), -1.0, None
        for epoch in range(config.max_epochs):
            model = _mlp(training, config, STEPS_PER_EPOCH, state, width)
            state = model.weights
            m = _validate(model, val, config, weights)
            log.append((run_id, epoch, m["loss"], m["accuracy"], m["f1"], config.patience))
            if m["f1"] >= best_f1:
                best, best_f1, best_epoch = model, m["f1"], epoch
                lives = max(MIN_LIVES, config.patience)
            else:
                lives -= 1
                if stop_early and lives == 0:
                    break

    epochs = df.sparkSession.createDataFrame(log, LOG_SCHEMA)
    return Session(
        best, epochs,
        avg_acc=sum(row[3] for row in log) / len(log),
        avg_f1=sum(row[4] for row in log) / len(log),
        last_epoch=log[-1][1] + 1, best_epoch=best_epoch,
        test=None if test is None else _validate(best, test, config, weights),
    )
