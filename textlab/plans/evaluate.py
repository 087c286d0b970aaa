"""Validation and test of scored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.scoring import bce_term, nll_term
from textlab.operators.embed import EncoderFactory, embed
from textlab.operators.labelled import clean, labelled
from textlab.operators.metrics import (
    binary_counts,
    classification_report,
    per_class,
    ratio,
)
from textlab.operators.small import lookup_join
from textlab.plans.fit import score
from textlab.sources.delimited import read_labelled_csv


def evaluate(
    df: DataFrame,
    multiclass: bool = False,
    label: str = "label",
    pred: str = "pred",
    z: str = "z",
    logits: str = "logits",
    weights: DataFrame | None = None,
) -> DataFrame:
    """``loss, accuracy, f1`` of a scored table in one pass over it.

    Two classes: mean binary cross-entropy and F1 of class 1. Several: class-weighted
    cross-entropy and support-weighted F1.
    """
    if not multiclass:
        cells = df.agg(
            F.avg(bce_term(z, label)).alias("loss"),
            *[c.alias(n) for n, c in binary_counts(label, pred).items()],
        )
        tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
        return cells.select(
            "loss",
            ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        )
    table = df.select(label, pred, logits)
    if weights is None:
        table = table.withColumn("weight", F.lit(1.0))
    else:
        table = lookup_join(table, weights.select(label, "weight"), label)
    cells = table.groupBy(label, pred).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("weight") * nll_term(logits, label)).alias("_loss"),
        F.sum("weight").alias("_weight"),
    )
    classes = per_class(cells, label, pred, ("_loss", "_weight"))
    total = F.sum("support")
    return classes.agg(
        (F.sum("_loss") / F.sum("_weight")).alias("loss"),
        ratio(F.sum("hits"), total).alias("accuracy"),
        ratio(F.sum(F.col("f1") * F.col("support")), total).alias("f1"),
    )


def embed_labelled(
    df: DataFrame,
    encoder: str | EncoderFactory,
    names: Mapping[str, str] | None = None,
    batch_size: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """Cleaned and embedded ``row_id, text, label`` table. ``partitions`` spreads the
    raw rows first, for inputs of few large blocks."""
    if partitions is not None:
        df = df.repartition(partitions)
    return embed(clean(df, "text", names), encoder, "text", batch_size)


def evaluate_file(
    spark: SparkSession,
    model: Model,
    path: str,
    encoder: str | EncoderFactory | None = None,
    multiclass: bool = False,
    batch_size: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Score a labelled CSV file: its metrics row and its classification report."""
    if encoder is None:
        raise TypeError("pass an encoder name or an encoder factory")
    table = labelled(read_labelled_csv(spark, path))
    scored = score(model, embed_labelled(table, encoder, batch_size=batch_size), multiclass=multiclass)
    return evaluate(scored, multiclass), classification_report(scored)
