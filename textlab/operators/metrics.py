"""Classification metrics as aggregates.

The only pass over the predictions is one partially combined aggregation; everything
after it works on at most (number of classes)² rows. Undefined ratios are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.scoring import bce_term, nll_term
from textlab.operators.small import lookup_join


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def pair_predictions(
    targets: DataFrame, predictions: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Targets and predictions matched by key; row order is no key on a cluster."""
    return targets.join(predictions, row_id, "inner")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse label frequencies scaled to sum 1: ``label, n, weight``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum(1.0 / F.col("n"))).scalar()
    return counts.select(label, "n", ((1.0 / F.col("n")) / total).alias("weight"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Share of equal labels, as a fraction."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Row counts per (label, pred)."""
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def binary_counts(label: str = "label", pred: str = "pred") -> dict[str, Column]:
    """Aggregates for the four cells; the positive class is 1."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return {
        "tp": F.count_if(y & p), "fp": F.count_if(~y & p),
        "fn": F.count_if(y & ~p), "tn": F.count_if(~y & ~p),
    }


def binary_scores(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Cells, accuracy, precision, recall and F1 of the positive class in one pass."""
    cells = df.agg(*[c.alias(n) for n, c in binary_counts(label, pred).items()])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def per_class(
    cells: DataFrame, label: str = "label", pred: str = "pred", sums: tuple[str, ...] = ()
) -> DataFrame:
    """Class table from confusion cells ``label, pred, n``: hits, support, predicted,
    precision, recall and F1 for every class seen as label or prediction. Further
    ``sums`` of a cell count for its label."""
    hit = F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(label).cast("bigint").alias("class"), F.col("n").alias("support"),
                 none.alias("predicted"), hit.cast("bigint").alias("hits"), *sums),
        F.struct(F.col(pred).cast("bigint").alias("class"), none.alias("support"),
                 F.col("n").alias("predicted"), none.alias("hits"),
                 *[F.lit(0.0).alias(s) for s in sums]),
    )
    table = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits", *sums)])
    )
    scored = table.withColumns({
        "precision": ratio(F.col("hits"), F.col("predicted")),
        "recall": ratio(F.col("hits"), F.col("support")),
    })
    return scored.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def class_scores(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """`per_class` of a prediction table."""
    return per_class(confusion(df, label, pred), label, pred)


def weighted_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """F1 per class averaged by support."""
    total = F.sum("support")
    return class_scores(df, label, pred).agg(
        ratio(F.sum(F.col("f1") * F.col("support")), total).alias("f1")
    )


def classification_report(
    df: DataFrame, label: str = "label", pred: str = "pred"
) -> DataFrame:
    """``class, precision, recall, f1, support``: one row per class, then ``accuracy``
    (its value in the f1 column), ``macro avg`` and ``weighted avg``."""
    return report_of(class_scores(df, label, pred))


def report_of(classes: DataFrame) -> DataFrame:
    """The classification report of a `per_class` table."""
    total = F.sum("support")
    values = ("precision", "recall", "f1")
    macro = [F.avg(v).alias(v) for v in values]
    weighted = [ratio(F.sum(F.col(v) * F.col("support")), total).alias(v) for v in values]
    blank = F.lit(None).cast("double")
    summary = classes.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), blank.alias("precision"),
                     blank.alias("recall"), ratio(F.sum("hits"), total).alias("f1"),
                     total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *macro, total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *weighted, total.alias("support")),
        ).alias("rows")
    ).select(F.inline("rows"))
    rows = classes.select(F.col("class").cast("string").alias("class"), *values, "support")
    return rows.unionByName(summary)


# -- losses -----------------------------------------------------------------

def bce_loss(df: DataFrame, z: str = "z", label: str = "label") -> DataFrame:
    """Mean binary cross-entropy on logits."""
    return df.agg(F.avg(bce_term(z, label)).alias("loss"))


def weighted_ce_loss(
    df: DataFrame, weights: DataFrame, logits: str = "logits", label: str = "label"
) -> DataFrame:
    """Class-weighted cross-entropy: weighted mean of the negative log-likelihoods."""
    weighted = lookup_join(df.select(label, logits), weights.select(label, "weight"), label)
    w = F.col("weight")
    return weighted.agg((F.sum(w * nll_term(logits, label)) / F.sum(w)).alias("loss"))


def epoch_loss(
    df: DataFrame, term: Column, batch: str = "batch_id", compat: bool = False
) -> DataFrame:
    """Loss of an epoch: the mean of ``term``, or with ``compat`` the sum of the batch
    means over the number of rows (about the mean divided by the batch size)."""
    if not compat:
        return df.agg(F.avg(term).alias("loss"))
    per_batch = df.groupBy(batch).agg(F.avg(term).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    return per_batch.agg((F.sum("_mean") / F.sum("_n")).alias("loss"))


def l1_penalty(weights: DataFrame, coeff: float) -> DataFrame:
    """``coeff`` times the absolute sum of a weight table ``w ARRAY, is_bias``, biases
    left out."""
    size = F.aggregate(
        F.col("w").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + F.abs(x)
    )
    total = F.coalesce(F.sum(size), F.lit(0.0))
    return weights.where(~F.col("is_bias")).agg((total * F.lit(coeff)).alias("penalty"))
