"""Fitting and scoring of classifiers on vectors, with MLlib's distributed solvers."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.scoring import Layer, predict_binary, predict_multiclass, score_head
from textlab.operators.metrics import class_weights
from textlab.operators.small import lookup_join
from textlab.plans.train import TrainedHead

FEATURES, WEIGHT = "_features", "_weight"


def _prepared(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.select(
        array_to_vector(F.col(vector)).alias(FEATURES), F.col(label).cast("double").alias("label")
    )


def fit_linear(
    df: DataFrame,
    vector: str = "embedding",
    label: str = "label",
    multiclass: bool = False,
    l1: float = 0.0,
    weight_decay: float = 0.0,
    max_iter: int = 100,
    weights: DataFrame | None = None,
) -> LogisticRegressionModel:
    """Logistic regression with L1 and L2 penalty; several classes are weighted by
    inverse frequency unless ``weights`` (``label, weight``) are given. Gradients are summed on the executors in a tree.

    Unlike a ReLU head this has no hidden layer; a given ReLU head can be scored exactly
    with ``functions.scoring.score_head``.
    """
    data = _prepared(df, vector, label)
    penalty = l1 + weight_decay
    solver = LogisticRegression(
        featuresCol=FEATURES, labelCol="label", maxIter=max_iter, standardization=False,
        regParam=penalty, elasticNetParam=l1 / penalty if penalty else 0.0,
        family="multinomial" if multiclass else "binomial",
    )
    if multiclass:
        weights = class_weights(data) if weights is None else weights
        weights = weights.select(F.col("label").cast("double").alias("label"), F.col("weight").alias(WEIGHT))
        data = lookup_join(data, weights, "label")
        solver = solver.setWeightCol(WEIGHT)
    return solver.fit(data)


def fit_mlp(
    df: DataFrame,
    vector: str = "embedding",
    label: str = "label",
    width: int | None = None,
    hidden: tuple[int, ...] = (64,),
    classes: int = 2,
    max_iter: int = 100,
    seed: int = 42,
    block_size: int = 128,
    sgd_rate: float | None = None,
    start: Vector | None = None,
) -> MultilayerPerceptronClassificationModel:
    """Perceptron with hidden layers; ``start`` continues from earlier weights.

    Known differences to a ReLU head: sigmoid hidden units, no class weights, no L1 and
    no dropout, as MLlib offers none of them.
    """
    if width is None:
        width = df.select(F.size(vector)).first()[0]
    solver = MultilayerPerceptronClassifier(
        featuresCol=FEATURES, labelCol="label", layers=[width, *hidden, classes],
        maxIter=max_iter, seed=seed, blockSize=block_size,
        solver="l-bfgs" if sgd_rate is None else "gd",
    )
    if sgd_rate is not None:
        solver = solver.setStepSize(sgd_rate)
    if start is not None:
        solver = solver.setInitialWeights(start)
    return solver.fit(_prepared(df, vector, label))


def score(
    model: Model | TrainedHead, df: DataFrame, vector: str = "embedding", multiclass: bool = False
) -> DataFrame:
    """Adds ``logits``, the logit ``z`` (two classes) and ``pred``."""
    if isinstance(model, TrainedHead):
        scored = df.withColumn("logits", score_head(vector, model.layers))
        if multiclass:
            return scored.withColumn("pred", predict_multiclass("logits"))
        return scored.withColumn("z", F.get("logits", F.lit(0))).withColumn("pred", predict_binary("z"))
    plain = model.copy({
        model.getParam("rawPredictionCol"): "_raw", model.getParam("probabilityCol"): "",
        model.getParam("predictionCol"): "",
    })
    scored = plain.transform(df.withColumn(FEATURES, array_to_vector(F.col(vector))))
    scored = scored.withColumn("logits", vector_to_array(F.col("_raw"))).drop("_raw", FEATURES)
    if multiclass:
        return scored.withColumn("pred", predict_multiclass("logits"))
    # Two outputs stand for one logit: its half and minus half, or two class scores.
    spread = F.get("logits", F.lit(1)) - F.get("logits", F.lit(0))
    scale = 2.0 if isinstance(model, LogisticRegressionModel) else 1.0
    return scored.withColumn("z", spread / scale).withColumn("pred", predict_binary("z"))


def head_layers(model: LogisticRegressionModel) -> list[Layer]:
    """Weights of a fitted linear model for ``score_head``."""
    matrix = model.coefficientMatrix.toArray()
    return [Layer.of(matrix.tolist(), model.interceptVector.toArray().tolist())]
