import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import loop_early_stop
from textlab.operators import logs, sampling

quick = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
RUNS = st.lists(st.tuples(st.lists(st.sampled_from([0.0, 0.2, 0.4, 0.5, 0.9]), min_size=1, max_size=14),
                          st.integers(2, 5)), min_size=1, max_size=12)


def log_table(spark, runs):
    rows = [(i, e, s, s / 2, p) for i, (scores, p) in enumerate(runs) for e, s in enumerate(scores)]
    return spark.createDataFrame(rows, "run_id int, epoch int, f1 double, accuracy double, patience int")


@quick
@given(RUNS, st.sampled_from([3, 65_536]))
def test_early_stop_equals_loop(spark, runs, width):
    df = log_table(spark, runs)
    got = {r["run_id"]: r for r in logs.early_stop(df, width=width).collect()}
    means = {r["run_id"]: r for r in logs.run_summary(df, width=width).collect()}
    for i, (scores, p) in enumerate(runs):
        last, best = loop_early_stop(scores, p)
        assert (got[i]["last_epoch"], got[i]["best_epoch"], got[i]["best_f1"]) == (last, best, scores[best])
        assert means[i]["avg_f1"] == pytest.approx(sum(scores[:last]) / last)
        assert means[i]["last_epoch"] == last


def test_early_stop_golden(spark):
    df = log_table(spark, [([0.5, 0.6, 0.4, 0.4, 0.6, 0.1, 0.2, 0.3, 0.9], 3)])
    assert tuple(logs.early_stop(df).first())[1:] == (8, 4, 0.6)
    assert tuple(logs.early_stop(df, enabled=False).first())[1:] == (9, 8, 0.9)


@quick
@given(RUNS, st.sampled_from([2, 65_536]))
def test_improvements_equal_loop(spark, runs, width):
    got = {(r["run_id"], r["epoch"]): r["improved"]
           for r in logs.improvement_flags(log_table(spark, runs), width=width).collect()}
    for i, (scores, _) in enumerate(runs):
        best = -1.0
        for e, s in enumerate(scores):
            assert got[i, e] == (s > best)
            best = max(best, s)


def test_best_per_trial_and_rankings(spark):
    golden = [("7f36d045", 1, 0.5974), ("0e5fd2e1", 10, 0.6375), ("6a909cfc", 20, 0.6984),
              ("b1a8a25d", 20, 0.6986), ("d3636359", 17, 0.7032)]
    reports = golden + [(t, i + 1, s) for t, i, s in golden] + [(t, i - 1, s / 2) for t, i, s in golden]
    df = spark.createDataFrame(reports, "trial string, iteration int, f1 double")
    best = logs.best_per_trial(df)
    assert sorted(map(tuple, best.collect())) == sorted(golden)
    assert [tuple(r) for r in logs.rank_trials(best, order="asc").collect()] == golden
    assert [tuple(r) for r in logs.rank_trials(best).collect()] == golden[::-1]
    assert logs.best_trial(best).first()["trial"] == "d3636359"
    with pytest.raises(ValueError):
        logs.rank_trials(best, order="up")


@quick
@given(st.lists(st.sampled_from([0.0, 0.5, 0.50001, 1.0]), min_size=1, max_size=30))
def test_rungs_keep_the_better_half(spark, scores):
    rows = [(i, it, s) for i, s in enumerate(scores) for it in (1, 5, 10, 20)]
    df = spark.createDataFrame(rows, "trial int, iteration int, f1 double")
    kept = logs.rung_survivors(df).collect()
    for rung in (5, 10):
        got = sorted((r["f1"] for r in kept if r["iteration"] == rung), reverse=True)
        assert got == sorted(scores, reverse=True)[: -(-len(scores) // 2)]
    assert {r["iteration"] for r in kept} <= {5, 10}


def test_rung_levels():
    assert logs.rung_levels(5, 2, 20) == [5, 10]
    with pytest.raises(ValueError):
        logs.rung_levels(5, 1, 20)


def test_cv_stats(spark):
    df = spark.createDataFrame([(1, 0.4, 0.6), (0, 0.2, 0.8), (2, None, None)], "fold int, avg_acc double, avg_f1 double")
    row = logs.cv_stats(df).first()
    assert row["completed_folds"] == 2
    assert (row["avg_f1_mean"], row["avg_f1_std"]) == pytest.approx((0.7, 0.1))
    assert row["avg_f1_values"] == [0.8, 0.6]
    tied = spark.createDataFrame([(3, 0.5), (1, 0.5)], "fold int, avg_f1 double")
    assert logs.best_fold(tied).first()["fold"] == 1


def test_sample_space_laws(spark):
    df = sampling.sample_space(spark.range(2000).toDF("trial"))
    assert df.count() == 2000
    row = df.agg(*[F.min(c).alias(f"min_{c}") for c in ("LR", "PATIENCE")],
                 *[F.max(c).alias(f"max_{c}") for c in ("LR", "PATIENCE")],
                 F.count_if(F.col("REDUX").isNull()).alias("none"),
                 F.avg((F.log("LR") < F.log(F.lit((2e-5 * 5e-3) ** 0.5))).cast("int")).alias("low")).first()
    assert 2e-5 <= row["min_LR"] and row["max_LR"] < 5e-3
    assert (row["min_PATIENCE"], row["max_PATIENCE"]) == (2, 5)
    assert 400 < row["none"] < 600 and 0.45 < row["low"] < 0.55
    again = sampling.sample_space(spark.range(2000).toDF("trial"))
    assert df.exceptAll(again).count() == 0
