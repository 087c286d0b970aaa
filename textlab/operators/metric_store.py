"""Metrics that grow with the predictions: sums per run and part, merged on read.

A part (a file, a day, a batch) of scored rows is reduced to one row per (label, predicted
class) with its count, loss and weight. Parts are stored by run and part; storing a part
again replaces it. Merged sums give the same loss, accuracy, F1 and report as an evaluation
of all predictions, which are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.scoring import bce_term, nll_term
from textlab.operators.metrics import per_class, ratio, report_of
from textlab.operators.small import lookup_join

_SCHEMA = "label int, pred int, n bigint, loss double, weight double, run string, part string"


def metric_part(
    scored: DataFrame, multiclass: bool = False, label: str = "label", pred: str = "pred", z: str = "z",
    logits: str = "logits", weights: DataFrame | None = None,
) -> DataFrame:
    """``label, pred, n, loss, weight`` of scored rows: counts and sums of the loss terms, for
    several classes times the weight of the class (``weights``: ``label, weight``)."""
    weight = F.lit(1.0)
    rows = scored.select(F.col(label).alias("label"), F.col(pred).alias("pred"),
                         F.col(logits if multiclass else z).alias("score"))
    if multiclass and weights is not None:
        known = weights.select(F.col(label).alias("label"), "weight")
        rows, weight = lookup_join(rows, known, "label"), F.col("weight")
    term = nll_term("score", "label") if multiclass else bce_term("score", "label")
    return rows.groupBy(F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight * term).alias("loss"), F.sum(weight).alias("weight"))


def _names(*names: str) -> None:
    if any(not n or "/" in n or "=" in n for n in names):
        raise ValueError("names of runs and parts must not be empty or hold / or =")


def store_part(part: DataFrame, path: str, run: str, name: str) -> None:
    """Store the sums of a part; a part of the same name is replaced."""
    _names(run, name)
    part.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}/part={name}")


def merged_cells(spark: SparkSession, path: str) -> DataFrame:
    """``run, label, pred, n, loss, weight`` over all parts of every run."""
    parts = spark.read.schema(_SCHEMA).parquet(path)
    return parts.groupBy("run", "label", "pred").agg(
        F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("weight").alias("weight"))


def merged_metrics(spark: SparkSession, path: str, multiclass: bool = False) -> DataFrame:
    """``run, loss, accuracy, f1`` of every run: F1 of class 1, or weighted by support."""
    cells = merged_cells(spark, path)
    per_run = cells.groupBy("run").agg(
        (F.sum("loss") / F.sum("weight")).alias("loss"),
        ratio(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"),
        F.sum(F.when((F.col("label") == 1) & (F.col("pred") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("label") == 1) != (F.col("pred") == 1), F.col("n")).otherwise(0)).alias("off"))
    if not multiclass:
        return per_run.select("run", "loss", "accuracy",
                              ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("off")).alias("f1"))
    # A class counts by its rows, and by the rows in which it was predicted.
    sides = cells.select("run", F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"),
                         F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"))
    sides = sides.unionByName(cells.select(
        "run", F.col("pred").alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("hits")))
    classes = sides.groupBy("run", "class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hits")])
    f1 = ratio(2 * F.col("hits"), F.col("support") + F.col("said"))
    weighted = classes.groupBy("run").agg(ratio(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1"))
    return per_run.select("run", "loss", "accuracy").join(weighted, "run")


def merged_report(spark: SparkSession, path: str, run: str) -> DataFrame:
    """`classification_report` of a run from its stored sums."""
    cells = merged_cells(spark, path).where(F.col("run") == run)
    return report_of(per_class(cells, "label", "pred"))
