"""Fits, sessions, cross-validation, search and the whole experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query
from textlab.operators.metrics import classification_report
from textlab.operators.sampling import Choice, LogUniform
from textlab.operators.split import TRAIN, VALIDATION, exact_split
from textlab.plans.config import Config
from textlab.plans.crossval import cross_validate, refit
from textlab.plans.evaluate import embed_labelled, evaluate_file
from textlab.plans.fit import fit_linear, fit_mlp, head_layers, score
from textlab.plans.search import run_experiment, search
from textlab.plans.session import run_session
from textlab.functions.scoring import score_head
from textlab.sources.delimited import write_csv
from textlab.sources.storage import fresh_path, materialize

SMALL_SPACE = {"L1": LogUniform(1e-6, 5e-4), "WEIGHT_DECAY": LogUniform(1e-5, 1e-1),
               "H_DIM": Choice((8, 16))}


def vectors(spark, sf, classes: int):
    """The embeddings table with its label folded to 2 or 4 classes."""
    return V.embeddings(spark, sf).select(
        F.col("vec_id").alias("row_id"), "embedding", (F.col("label") % classes).alias("label")
    )


def embedded_tweets(spark, sf):
    tasks = spark.sparkContext.defaultParallelism
    rows = V.labelled_tweets(spark, sf)
    return materialize(embed_labelled(rows, "hashing", partitions=tasks), "tweets")


@query("fit_linear")
def fit_linear_binary(spark, sf):
    data = vectors(spark, sf, 2)
    scored = score(fit_linear(data, l1=1e-4, weight_decay=1e-3, max_iter=50), data)
    return scored.select("row_id", "label", "pred")


@query("fit_linear_multiclass")
def fit_linear_multiclass(spark, sf):
    data = vectors(spark, sf, 4)
    model = fit_linear(data, multiclass=True, weight_decay=1e-3, max_iter=50)
    return classification_report(score(model, data, multiclass=True))


@query("fit_mlp")
def fit_mlp_binary(spark, sf):
    data = vectors(spark, sf, 2)
    return classification_report(score(fit_mlp(data, hidden=(8,), max_iter=30), data))


@query("score_fitted_head", "SELECT vec_id AS row_id, true AS same FROM embeddings")
def score_fitted_head(spark, sf):
    """A fitted linear model scored from its weight table, next to MLlib's own score."""
    data = vectors(spark, sf, 4)
    model = fit_linear(data, multiclass=True, max_iter=20)
    own = score(model, data, multiclass=True).withColumn(
        "again", score_head("embedding", head_layers(model))
    )
    gap = F.array_max(F.zip_with("logits", "again", lambda a, b: F.abs(a - b)))
    return own.select("row_id", (gap < 1e-9).alias("same"))


@query("run_session")
def session(spark, sf):
    done = run_session(embedded_tweets(spark, sf), Config(max_epochs=20, weight_decay=1e-3))
    return done.epochs


@query("run_session_mlp")
def session_mlp(spark, sf):
    config = Config(head="mlp", h_dim=8, max_epochs=3)
    return run_session(materialize(vectors(spark, sf, 2), "vectors"), config).epochs


@query("cross_validate")
def cross_validation(spark, sf):
    data = materialize(vectors(spark, sf, 4), "vectors")
    return cross_validate(data, Config(multi=True, max_epochs=10, weight_decay=1e-3)).folds


@query("refit")
def refit_all(spark, sf):
    data = vectors(spark, sf, 2)
    config = Config(weight_decay=1e-3)
    return classification_report(score(refit(data, config, 15), data))


@query("evaluate_file")
def evaluate_csv(spark, sf):
    raw = V.labelled_tweets(spark, sf)
    path = write_csv(raw.withColumnsRenamed({"text": "Tweet text", "label": "Label"}).select(
        "row_id", "Tweet text", "Label"), fresh_path(spark, "test-file"))
    model = fit_linear(embedded_tweets(spark, sf), weight_decay=1e-3, max_iter=20)
    return evaluate_file(spark, model, path, "hashing")[1]


@query("search")
def random_search(spark, sf):
    data = materialize(vectors(spark, sf, 2), "vectors")
    found = search(data, Config(samples=4, max_epochs=10), space=SMALL_SPACE)
    return found.ranked()


@query("run_experiment")
def experiment(spark, sf):
    rows = exact_split(V.labelled_tweets(spark, sf), 0.8, seed=7)
    train = rows.where(F.col("split") == TRAIN).drop("split")
    test = rows.where(F.col("split") == VALIDATION).drop("split")
    done = run_experiment(
        train, test, Config(samples=2, k=2, max_epochs=10), {"hashing": "hashing"},
        out=fresh_path(spark, "experiment"), space=SMALL_SPACE,
    )
    return done["hashing"].metrics

