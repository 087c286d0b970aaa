"""Result files: ranked trials, run summaries, fitted models and fold tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.labelled import merge_record
from textlab.operators.logs import rank_trials
from textlab.sources.delimited import write_csv


def write_ranked_trials(
    trials: DataFrame, path: str, f1: str = "f1", tie: str = "trial", order: str = "desc",
    k: int = 5,
) -> str:
    """The first ``k`` trials of a ranking as CSV, in rank order, without an index column."""
    return write_csv(rank_trials(trials, f1, tie, order, k).coalesce(1), path)


def write_summary(result: DataFrame, path: str, config: Mapping[str, Any] | None = None) -> str:
    """A one-row result as JSON, merged into its configuration (result values win).
    Missing settings are written as null."""
    clash = set(result.columns) & set(config or {})
    settings = {k: v for k, v in (config or {}).items() if k not in clash}
    merged = merge_record(result, settings).select(*settings, *result.columns)
    merged.coalesce(1).write.option("ignoreNullFields", False).json(path)
    return path


def save_run(
    path: str,
    model: PipelineModel | None = None,
    folds: DataFrame | None = None,
    split_by: str | None = None,
) -> str:
    """Model and fold table of one run under one folder. With ``split_by`` the table is
    partitioned on disk, so reading one fold skips the others."""
    if model is not None:
        model.write().save(f"{path}/model")
    if folds is not None:
        writer = folds.write
        if split_by:
            writer = writer.partitionBy(split_by)
        writer.parquet(f"{path}/folds")
    return path


def load_model(path: str) -> PipelineModel:
    """Model of a saved run."""
    return PipelineModel.load(f"{path}/model")


def run_id(prefix: str = "run"):
    """A run name from the current time, as a column."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(F.current_timestamp(), "yyyy_MM_dd_HH_mm"))
