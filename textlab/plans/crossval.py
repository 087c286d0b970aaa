"""k-fold cross-validation and the final fit on all rows."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.logs import best_fold, cv_stats
from textlab.operators.split import TRAIN, VALIDATION, kfold, stratified_kfold
from textlab.plans.config import Config
from textlab.plans.session import Session, fit_once, run_session, session_of
from textlab.plans.train import Member, prepare, train

FOLD_SCHEMA = "fold int, avg_acc double, avg_f1 double, last_epoch int"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CrossValidation:
    """Fold table, its statistics, and the session of the best fold."""

    folds: DataFrame
    stats: DataFrame
    best_fold: int
    best: Session
    cv_type: str

    def summary(self, config: Config, run_id: str) -> DataFrame:
        """One row for the JSON summary."""
        return self.stats.select(
            F.lit(run_id).alias("run_id"), F.lit(self.cv_type).alias("cv_type"),
            F.lit(config.k).alias("n_folds"), F.lit(self.best_fold).alias("best_fold"),
            F.lit(self.best.avg_f1).alias("best_f1"), "*",
        )


def in_parallel(spark, jobs: list[Callable], parallelism: int) -> list:
    """Results of driver-side jobs submitted together; an exception takes its job's place."""
    def guarded(job: Callable):
        try:
            return job()
        except Exception as e:  # one failed job must not end the others
            return e

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(guarded), jobs))


def cross_validate(
    df: DataFrame,
    config: Config,
    stratified: bool = True,
    parallelism: int = 2,
    session: Callable[..., Session] = run_session,
) -> CrossValidation:
    """Run one session per fold of an embedded table and compare them.

    Folds are column values, so training and validation sides are filters of one stored
    table. A failed fold is skipped; without any completed fold this raises. The best
    fold is the one with the highest mean F1 over its epochs, the first on ties.

    Heads that are trained step by step (``config.first_order``) learn all folds side by
    side: every pass over the table serves each fold with the rows outside of it, so k
    folds take as many passes as the longest of them. Other heads run one session per
    fold, ``parallelism`` at a time.
    """
    folded = df if "fold" in df.columns else (
        stratified_kfold(df, config.k, config.seed) if stratified
        else kfold(df, config.k, config.seed)
    )

    if config.first_order and session is run_session:
        results = _side_by_side(folded, config)
        return _compared(df.sparkSession, results, stratified)

    def job(i: int) -> Callable[[], Session]:
        side = F.when(F.col("fold") == i, VALIDATION).otherwise(TRAIN)
        return lambda: session(folded.withColumn("split", side), config, f"fold{i}")

    results = in_parallel(df.sparkSession, [job(i) for i in range(config.k)], parallelism)
    return _compared(df.sparkSession, results, stratified)


def _side_by_side(folded: DataFrame, config: Config) -> list[Session | Exception]:
    table = prepare(folded, "fold", batches=config.steps, seed=config.seed)
    done = train(table, [Member(f"fold{i}", config, i) for i in range(config.k)])
    out: list[Session | Exception] = []
    for learner in done.learners:
        try:
            out.append(session_of(learner, folded.sparkSession))
        except RuntimeError as e:
            out.append(e)
    return out


def _compared(spark, results: list, stratified: bool) -> CrossValidation:
    done: dict[int, Session] = {}
    for i, r in enumerate(results):
        if isinstance(r, Exception):
            log.warning("fold %d failed: %s", i, r)
        else:
            done[i] = r
    if not done:
        raise RuntimeError("no fold completed") from results[0]
    rows = [(i, s.avg_acc, s.avg_f1, s.last_epoch) for i, s in done.items()]
    folds = spark.createDataFrame(rows, FOLD_SCHEMA)
    best = best_fold(folds).first()["fold"]
    kind = "stratified" if stratified else "regular"
    return CrossValidation(folds, cv_stats(folds), best, done[best], kind)


def refit(df: DataFrame, config: Config, epochs: int) -> Model:
    """Fit on every row with the chosen settings; ``epochs`` comes from the best fold."""
    return fit_once(df, config, epochs)
