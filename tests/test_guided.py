import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.functions.keys import hash_uniform
from textlab.operators.guided import _Options, _Range, propose, split_trials
from textlab.operators.sampling import Choice, LogUniform, RandInt, sample_space
from textlab.plans.config import Config
from textlab.plans.search import search_guided

SPACE = {"LR": LogUniform(1e-5, 1e-1), "H_DIM": Choice((8, 16, 32, None)), "PATIENCE": RandInt(2, 8)}


def ids(spark, a, b):
    return spark.range(a, b).select(F.format_string("t%05d", "id").alias("trial"))


def scored(df):
    """Best at a rate of 3e-3, 16 units and a patience of 5."""
    far = F.pow(F.log("LR") - math.log(3e-3), F.lit(2.0)) / 10
    units = F.when(F.col("H_DIM") == 16, 0.0).otherwise(1.0)
    return df.withColumn("f1", -far - units - F.abs(F.col("PATIENCE") - 5) / 3)


def local(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_beats_random_draws_on_a_planted_optimum(spark):
    random = scored(sample_space(ids(spark, 0, 36), space=SPACE)).agg(F.max("f1"), F.avg("f1")).first()
    seen = local(spark, scored(sample_space(ids(spark, 0, 12), space=SPACE)))
    for at in (12, 24):
        new = scored(propose(ids(spark, at, at + 12), seen, space=SPACE))
        seen = local(spark, seen.unionByName(local(spark, new)))
    guided = seen.where("trial >= 't00012'").agg(F.max("f1"), F.avg("f1")).first()
    assert guided[0] > random[0] and guided[1] > random[1] + 1.0


def test_seeded_and_inside_the_space(spark):
    seen = local(spark, scored(sample_space(ids(spark, 0, 9), space=SPACE)))
    new = [propose(ids(spark, 50, 90).repartition(n), seen.repartition(n), space=SPACE).orderBy("trial").collect()
           for n in (1, 5)]
    assert new[0] == new[1]
    assert new[0] != propose(ids(spark, 50, 90), seen, space=SPACE, seed=7).orderBy("trial").collect()
    for r in new[0]:
        assert 1e-5 <= r["LR"] <= 1e-1 and r["H_DIM"] in (8, 16, 32, None) and 2 <= r["PATIENCE"] < 8


@pytest.mark.parametrize("n", [0, 1])
def test_without_trials_to_follow(spark, n):
    seen = scored(sample_space(ids(spark, 0, 3), space=SPACE)).limit(n)
    rows = propose(ids(spark, 0, 60), seen, space=SPACE).collect()
    assert len(rows) == 60 and len({r["LR"] for r in rows}) > 30
    assert {r["H_DIM"] for r in rows} == {8, 16, 32, None} or n == 1


def test_odd_trials_are_not_learned_from(spark):
    schema = "trial string, f1 double, LR double, H_DIM int, PATIENCE int"
    rows = [("a", None, 1e-3, 16, 4), ("b", float("nan"), 1e-3, 16, 4), ("c", 0.5, 1e-3, 77, None), ("d", 0.4, 2e-3, 8, 3)]
    seen = spark.createDataFrame(rows, schema)
    assert [(r["trial"], r["better"]) for r in split_trials(seen).orderBy("trial").collect()] == [
        ("c", True), ("d", False)]
    assert propose(ids(spark, 0, 5), seen, space=SPACE).count() == 5


@pytest.mark.parametrize("seen", [[], [-2.0], [-4.9, 0.3, 0.4, 0.9]])
def test_densities_sum_to_one_and_draws_follow_them(spark, seen):
    line, listed = _Range(-5.0, 1.0), _Options(4)
    values = F.array(*[F.lit(x) for x in seen]).cast("array<double>")
    grid = spark.range(6000).select(((F.col("id") + 0.5) / 1000 - 5).alias("x"))
    total = grid.select(F.sum(line.density(values, F.col("x")) / 1000)).first()[0]
    assert total == pytest.approx(1.0, abs=1e-4)
    places = F.array(*[F.lit(float(i % 4)) for i in range(len(seen))]).cast("array<double>")
    p = spark.range(4).select(listed.density(places, F.col("id").cast("double"))).collect()
    assert sum(r[0] for r in p) == pytest.approx(1.0)
    draws = spark.range(8000).select(line.draw(
        values, hash_uniform("pick", "id"), hash_uniform("value", "id")).alias("x"))
    got = np.histogram([r["x"] for r in draws.collect()], bins=6, range=(-5, 1))[0] / 8000
    want = [r[0] for r in grid.groupBy(F.floor("x").alias("b")).agg(
        F.sum(line.density(values, F.col("x")) / 1000).alias("p")).orderBy("b").select("p").collect()]
    assert np.allclose(got, want, atol=0.03)


def test_guided_search_needs_a_trained_head(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "row_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="guided"):
        search_guided(df, Config())
    with pytest.raises(ValueError, match="batch"):
        search_guided(df, Config(head="relu", opt="SGD"), batch=0)
