"""Queries over training logs: epochs of runs, folds, trials and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.keys import key_bucket, shuffle_key
from textlab.operators.ranks import beyond, find_cuts, fits_one_block, running_max

MIN_LIVES = 3
NO_STOP = 2**31 - 1


# -- epochs of a run --------------------------------------------------------

def _with_stop(
    df: DataFrame, run: str, epoch: str, f1: str, patience: str | Column, enabled: bool,
    width: int,
) -> DataFrame:
    """Adds ``_best`` (score and epoch of the best so far; an equal score counts as
    better) and ``_stop``, the epoch the run ends after."""
    score = F.struct(F.col(f1).alias("f1"), F.col(epoch).alias("epoch"))
    short = fits_one_block(df, epoch, width)
    run_best = running_max(df, run, epoch, score, "_best", width=width, one_block=short)
    if not enabled:
        return run_best.withColumn("_stop", F.lit(NO_STOP))
    p = F.col(patience) if isinstance(patience, str) else patience
    out_of_lives = F.col(epoch) - F.col("_best.epoch") >= F.greatest(F.lit(MIN_LIVES), p)
    stop = F.when(out_of_lives, F.col(epoch))
    whole_run = Window.partitionBy(run)
    if short:
        first = F.min(stop).over(whole_run)
        return run_best.withColumn("_stop", F.coalesce(first, F.lit(NO_STOP)))
    # One row per block: the run's first stop is handed to all its blocks, so the join
    # keeps the partitioning of the windows.
    blocks = run_best.groupBy(run, "_block").agg(F.min(stop).alias("_first"))
    stops = blocks.select(
        run, "_block",
        F.coalesce(F.min("_first").over(whole_run), F.lit(NO_STOP)).alias("_stop"),
    )
    return run_best.join(stops, [run, "_block"])


def epochs_run(
    df: DataFrame, run: str = "run_id", epoch: str = "epoch", f1: str = "f1",
    patience: str | Column = "patience", enabled: bool = True, width: int = 65_536,
) -> DataFrame:
    """Rows of the epochs that take place under early stopping.

    Epoch 0 is best; a lower score costs one of ``max(3, patience)`` lives, an equal or
    higher one restores them; the epoch that takes the last life is the run's last.
    """
    stopped = _with_stop(df, run, epoch, f1, patience, enabled, width)
    return stopped.where(F.col(epoch) <= F.col("_stop")).select(*df.columns, "_best")


def early_stop(
    df: DataFrame, run: str = "run_id", epoch: str = "epoch", f1: str = "f1",
    patience: str | Column = "patience", enabled: bool = True, width: int = 65_536,
) -> DataFrame:
    """Per run: epochs run (``last_epoch``), best epoch and its score. Without early
    stopping the best is the maximum over all epochs."""
    ran = epochs_run(df, run, epoch, f1, patience, enabled, width)
    return ran.groupBy(run).agg(
        (F.max(epoch) + 1).cast("int").alias("last_epoch"), F.max("_best").alias("_best")
    ).select(
        run, "last_epoch",
        F.col("_best.epoch").alias("best_epoch"), F.col("_best.f1").alias("best_f1"),
    )


def run_summary(
    df: DataFrame, run: str = "run_id", epoch: str = "epoch", f1: str = "f1",
    accuracy: str = "accuracy", patience: str | Column = "patience", enabled: bool = True,
    width: int = 65_536,
) -> DataFrame:
    """Per run: mean validation accuracy and F1 over the epochs run, and their number."""
    ran = epochs_run(df, run, epoch, f1, patience, enabled, width)
    return ran.groupBy(run).agg(
        F.avg(accuracy).alias("avg_acc"),
        F.avg(f1).alias("avg_f1"),
        (F.max(epoch) + 1).cast("int").alias("last_epoch"),
    )


def improvement_flags(
    df: DataFrame, run: str = "run_id", epoch: str = "epoch", f1: str = "f1",
    width: int = 65_536,
) -> DataFrame:
    """Adds ``improved``: score strictly above everything before (start: -1)."""
    before = running_max(df, run, epoch, F.col(f1), "_before", inclusive=False, width=width)
    flag = F.col(f1) > F.coalesce(F.col("_before"), F.lit(-1.0))
    return before.select(*df.columns, flag.alias("improved"))


# -- trials -----------------------------------------------------------------

def best_per_trial(
    df: DataFrame, trial: str = "trial", iteration: str = "iteration", f1: str = "f1"
) -> DataFrame:
    """The report with the best score of every trial, the earliest one on ties.

    A maximum is combined before the shuffle, so a trial with very many reports is no
    hot partition as it would be in a window.
    """
    rest = F.struct(*[c for c in df.columns if c != trial])
    best = df.groupBy(trial).agg(
        F.max_by(rest, F.struct(F.col(f1), -F.col(iteration))).alias("_row")
    )
    return best.select(*[trial if c == trial else F.col("_row")[c].alias(c) for c in df.columns])


def rung_survivors(
    df: DataFrame, trial: str = "trial", iteration: str = "iteration", f1: str = "f1",
    grace: int = 5, factor: int = 2, cap: int = 20, seed: int = 42,
) -> DataFrame:
    """Halving rungs at ``grace * factor**i`` below ``cap``: at each rung the better
    ``1/factor`` (rounded up) of the reports survive; ties are drawn by seeded digest.

    The search for a rung's cut narrows from score levels to one score and on to a byte
    of the digest, so a score shared by very many trials is not ranked in one task.
    """
    rungs = rung_levels(grace, factor, cap)
    reports = (
        df.where(F.col(iteration).isin(rungs))
        .withColumn("_loss", -F.col(f1))
        .withColumn("_key", shuffle_key(seed, trial))
    )
    order = ["_loss", "_key"]
    score = F.least(F.greatest(F.col(f1), F.lit(0.0)), F.lit(1.0))
    level = F.floor((1.0 - score) * 4095)
    buckets = [level, F.col("_loss"), key_bucket(F.col("_key"))]

    def targets(sizes: dict) -> dict:
        return {g: [-(-n // factor)] for g, n in sizes.items()}

    # The rungs grow geometrically, so they always fit the literal form; the few reports
    # at the rungs are read by every step of the search.
    narrow = reports.select(iteration, f1, *order).persist()
    try:
        _, cuts = find_cuts(narrow, buckets, order, targets, by=iteration)
    finally:
        narrow.unpersist()
    keep = F.lit(False)
    for rung, cut in cuts.items():
        keep = keep | ((F.col(iteration) == rung) & ~beyond(order, cut[0]))
    return reports.where(keep).select(*df.columns)


def rung_levels(grace: int, factor: int, cap: int) -> list[int]:
    """Iterations at which trials are compared."""
    if grace < 1 or factor < 2:
        raise ValueError("grace must be positive and factor at least 2")
    levels = []
    while grace < cap:
        levels.append(grace)
        grace *= factor
    return levels


def rank_trials(
    df: DataFrame, f1: str = "f1", tie: str = "trial", order: str = "desc", k: int | None = 5
) -> DataFrame:
    """Trials by score, best first; ``order="asc"`` lists the worst first."""
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    score = F.col(f1).asc() if order == "asc" else F.col(f1).desc()
    ranked = df.orderBy(score, F.asc(tie))
    return ranked if k is None else ranked.limit(k)


def best_trial(df: DataFrame, f1: str = "f1", tie: str = "trial") -> DataFrame:
    """The trial with the highest score."""
    return rank_trials(df, f1, tie, k=1)


# -- folds ------------------------------------------------------------------

def best_fold(df: DataFrame, f1: str = "avg_f1", fold: str = "fold") -> DataFrame:
    """The fold with the highest mean score, the first one on ties."""
    return df.orderBy(F.desc(f1), F.asc(fold)).limit(1)


def cv_stats(
    df: DataFrame, metrics: Sequence[str] = ("avg_acc", "avg_f1"), fold: str = "fold",
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean, population deviation and the values in fold order over the completed folds
    (rows with a metric). ``by`` separates cross-validation runs; a run has k folds."""
    done = df.where(F.col(metrics[0]).isNotNull())
    aggs = [F.count(F.lit(1)).alias("completed_folds")]
    for m in metrics:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(fold), F.col(m).alias("v"))))
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            F.transform(pairs, lambda p: p["v"]).alias(f"{m}_values"),
        ]
    return done.groupBy(*by).agg(*aggs)
