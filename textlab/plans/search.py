"""Hyper-parameter search and the whole experiment."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.embed import EncoderFactory
from textlab.operators.guided import propose
from textlab.operators.logs import (
    best_per_trial,
    best_trial,
    rank_trials,
    rung_levels,
    rung_survivors,
)
from textlab.operators.sampling import SEARCH_SPACE, sample_space
from textlab.operators.small import rows_if_small
from textlab.operators.split import VALIDATION, exact_split
from textlab.plans.config import Config
from textlab.plans.crossval import CrossValidation, cross_validate, in_parallel, refit
from textlab.plans.evaluate import embed_labelled, evaluate
from textlab.plans.fit import score
from textlab.plans.session import Session, run_session
from textlab.plans.train import Learner, Member, Table, Training, prepare, train
from textlab.sources.sinks import write_ranked_trials, write_summary
from textlab.sources.storage import materialize

log = logging.getLogger(__name__)
REPORT_SCHEMA = "trial string, iteration int, l double, f1 double"


@dataclass(frozen=True)
class Search:
    """Every epoch report, the best report per trial, and the best settings."""

    reports: DataFrame
    trials: DataFrame
    best: Config

    def ranked(self, order: str = "desc", k: int | None = 5) -> DataFrame:
        return rank_trials(self.trials, order=order, k=k)


def draw_configs(draws: DataFrame, config: Config) -> list[tuple[str, Config, dict]]:
    """Settings per row of drawn parameters. Each trial is trained by jobs that the driver
    submits, so the number of trials is small by nature and checked."""
    rows = rows_if_small(draws.orderBy("trial"))
    if rows is None:
        raise ValueError("too many trials for one driver")
    values = [(r["trial"], {k: v for k, v in r.asDict().items() if k != "trial"}) for r in rows]
    return [(t, Config.of(config.record() | d), d) for t, d in values]


def search(
    df: DataFrame,
    config: Config,
    ids: DataFrame | None = None,
    space: Mapping = SEARCH_SPACE,
    parallelism: int = 2,
    fit_fn: Callable[..., Session] = run_session,
) -> Search:
    """Random search: draw settings, train one session per trial on one shared exact
    split, and table every epoch report with its settings. Failed trials are left out.

    Heads trained step by step (``config.first_order``) are trained side by side, one pass
    over the table for all trials, to the last epoch; see ``search_halving`` for fewer.
    """
    spark = df.sparkSession
    ids = trial_ids(spark, config) if ids is None else ids
    draws = sample_space(ids.select("trial"), space=space, seed=config.seed)
    drawn = draw_configs(draws, config)
    if config.first_order and fit_fn is run_session:
        done = train(_shared_split(df, config), _members(drawn), stop_early=False)
        return _found(draws, drawn, reports_of(spark, done))
    table = exact_split(df, config.split, config.seed)
    jobs = [lambda t=t, c=c: fit_fn(table, c, t) for t, c, _ in drawn]
    results = in_parallel(spark, jobs, parallelism)

    reports = []
    for (trial, _, _), r in zip(drawn, results):
        if isinstance(r, Exception):
            log.warning("trial %s failed: %s", trial, r)
            continue
        reports.append(r.epochs.select(
            F.col("run_id").alias("trial"), (F.col("epoch") + 1).alias("iteration"),
            F.col("loss").alias("l"), "f1",
        ))
    if not reports:
        raise RuntimeError("no trial completed")
    rows = [tuple(row) for part in reports for row in part.collect()]
    return _found(draws, drawn, spark.createDataFrame(rows, REPORT_SCHEMA))


def trial_ids(spark: SparkSession, config: Config) -> DataFrame:
    """One row per trial of the settings."""
    return spark.range(config.samples).select(F.format_string("t%05d", F.col("id")).alias("trial"))


def _found(draws: DataFrame, drawn: list, reports: DataFrame) -> Search:
    named = draws.toDF("trial", *[f"config/{c}" for c in draws.columns[1:]])
    trials = best_per_trial(reports).join(named, "trial")
    winner = best_trial(trials).first()["trial"]
    by_trial = {t: c for t, c, _ in drawn}
    return Search(reports, trials, by_trial[winner])


def _shared_split(df: DataFrame, config: Config) -> Table:
    """The exact split of a search as folds: 0 validates, 1 trains."""
    split = exact_split(df, config.split, config.seed)
    held = split.withColumn("_held", F.when(F.col("split") == VALIDATION, 0).otherwise(1))
    return prepare(held, "_held", batches=config.steps, seed=config.seed)


def _members(drawn: list) -> list[Member]:
    return [Member(trial, config, 0) for trial, config, _ in drawn]


def reports_of(spark: SparkSession, done: Training) -> DataFrame:
    """Every epoch of every trial that has not failed."""
    rows = [(x.member.name, epoch + 1, loss, f1)
            for x in done.learners if not x.failed for epoch, loss, _, f1, *_ in x.log]
    if not rows:
        raise RuntimeError("no trial completed")
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def search_halving(
    df: DataFrame, config: Config, ids: DataFrame | None = None, space: Mapping = SEARCH_SPACE,
    grace: int = 5, factor: int = 2, path: str | None = None,
) -> Search:
    """Search that stops the weaker trials while they are trained.

    All trials are trained side by side up to the first rung; ``rung_survivors`` decides
    which reports go on from where they stopped to the next one, and the last ones reach
    ``max_epochs``. Settings, split and every trial's log up to its end are those of
    ``search``. With ``path`` the state after every epoch is stored below it, and a search
    that was cut off goes on from there.
    """
    spark = df.sparkSession
    if not config.first_order:
        raise ValueError("halving needs a head trained with AdamW or SGD")
    ids = trial_ids(spark, config) if ids is None else ids
    draws = sample_space(ids.select("trial"), space=space, seed=config.seed)
    drawn = draw_configs(draws, config)
    table, members = _shared_split(df, config), _members(drawn)
    by_name: dict[str, Learner] = {}
    done: Training | None = None
    for rung in [*rung_levels(grace, factor, config.max_epochs), config.max_epochs]:
        done = train(table, members, stop_early=False, until=rung, known=done,
                     path=None if path is None else f"{path}/rung={rung}")
        by_name |= {x.member.name: x for x in done.learners}
        reports = reports_of(spark, Training(list(by_name.values())))
        if rung < config.max_epochs:
            here = reports.where(F.col("iteration") == rung)
            kept = {r["trial"] for r in rung_survivors(
                here, grace=rung, factor=factor, cap=rung + 1, seed=config.seed).select("trial").collect()}
            members = [m for m in members if m.name in kept]
            done = Training([x for x in done.learners if x.member.name in kept], done.passes)
    return _found(draws, drawn, reports)


def search_guided(
    df: DataFrame, config: Config, space: Mapping = SEARCH_SPACE, batch: int = 4,
) -> Search:
    """Search in batches of trials: the first one is drawn at random, each later one follows
    the scores so far (``operators.guided.propose``). The trials of a batch are trained side
    by side on one shared exact split, ``config.samples`` trials in all."""
    if not config.first_order:
        raise ValueError("a guided search needs a head trained with AdamW or SGD")
    if batch < 1:
        raise ValueError("a batch needs at least one trial")
    spark = df.sparkSession
    ids = trial_ids(spark, config).withColumn("n", F.substring("trial", 2, 9).cast("int"))
    table = _shared_split(df, config)
    draws = reports = None
    drawn: list = []
    for at in range(0, config.samples, batch):
        now = ids.where((F.col("n") >= at) & (F.col("n") < at + batch)).select("trial")
        if reports is None:
            new = sample_space(now, space=space, seed=config.seed)
        else:
            seen = best_per_trial(reports).select("trial", "f1").join(draws, "trial")
            new = propose(now, seen, space=space, seed=config.seed)
        new = spark.createDataFrame(new.collect(), new.schema)  # one batch of trials
        some = draw_configs(new, config)
        done = train(table, _members(some), stop_early=False)
        drawn += some
        draws = new if draws is None else draws.unionByName(new)
        found = [x for x in done.learners if not x.failed]
        if found:
            part = reports_of(spark, Training(found))
            reports = part if reports is None else reports.unionByName(part)
    if reports is None:
        raise RuntimeError("no trial completed")
    return _found(draws, drawn, reports)


@dataclass(frozen=True)
class Experiment:
    """Outcome for one encoder."""

    search: Search
    validation: CrossValidation
    model: Model
    metrics: DataFrame


def run_experiment(
    train: DataFrame,
    test: DataFrame,
    config: Config,
    encoders: Mapping[str, str | EncoderFactory],
    out: str | None = None,
    space: Mapping = SEARCH_SPACE,
    parallelism: int = 2,
    names: Mapping[str, str] | None = None,
    partitions: int | None = None,
) -> dict[str, Experiment]:
    """Per encoder: embed both ``row_id, text, label`` tables once and store them, then
    search, cross-validate the best settings, refit on all training rows for as many
    epochs as the best fold ran, and test. With ``out`` the ranked trials (CSV), the
    cross-validation summary and the test metrics (JSON) are written below it."""
    done: dict[str, Experiment] = {}
    for name, encoder in encoders.items():
        base = config.with_(emb_model=name)
        embedded = materialize(
            embed_labelled(train, encoder, names, base.batch_size, partitions), f"train-{name}"
        )
        tested = materialize(
            embed_labelled(test, encoder, names, base.batch_size, partitions), f"test-{name}"
        )
        found = search(embedded, base, space=space, parallelism=parallelism)
        cv = cross_validate(embedded, found.best, parallelism=parallelism)
        final = found.best.with_(max_epochs=cv.best.last_epoch)
        model = refit(embedded, final, final.max_epochs)
        scores = evaluate(score(model, tested, multiclass=final.multi), final.multi)
        row = scores.first()
        metrics = train.sparkSession.createDataFrame(
            [(row["accuracy"], row["f1"])], "test_accuracy double, test_f1 double"
        )
        if out is not None:
            write_ranked_trials(found.trials, f"{out}/{name}/trials")
            write_summary(cv.summary(final, name), f"{out}/{name}/cv", final.record())
            write_summary(metrics, f"{out}/{name}/test_metrics", final.record())
        done[name] = Experiment(found, cv, model, metrics)
    return done
