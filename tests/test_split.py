import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import planned, wide_single_partitions
from textlab.functions.keys import key_bucket, shuffle_key
from textlab.operators import ranks, split

quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@quick
@given(st.integers(0, 60), st.sampled_from([0.0, 0.5, 0.8, 1.0]))
def test_exact_split(spark, n, fraction):
    rows = split.exact_split(spark.range(n).toDF("row_id"), fraction).collect()
    train = {r["row_id"] for r in rows if r["split"] == "train"}
    assert train == set(order(range(n))[: int(fraction * n)])
    assert len(rows) == n


@quick
@given(st.integers(0, 40), st.integers(2, 7))
def test_kfold(spark, n, k):
    rows = split.kfold(spark.range(n).toDF("row_id"), k).collect()
    want, at = {}, 0
    for fold in range(k):
        for _ in range(n // k + (fold < n % k)):
            want[order(range(n))[at]] = fold
            at += 1
    assert {r["row_id"]: r["fold"] for r in rows} == want


def test_kfold_beyond_literals(spark):
    df = spark.range(1300).toDF("row_id")
    sizes = [r["count"] for r in split.kfold(df, 600).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3] * 100 + [2] * 500


@quick
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(2, 5))
def test_stratified_sizes(spark, labels, k):
    df = spark.createDataFrame(list(enumerate(labels)), "row_id long, label int")
    got = split.stratified_kfold(df, k)
    counts = {(r["label"], r["fold"]): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    dealt = sorted(labels)
    for label in set(labels):
        for fold in range(k):
            assert counts.get((label, fold), 0) == dealt[fold::k].count(label)


def test_stratified_by_rank_is_the_same(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(100)], "row_id long, label int")
    literal = {r["row_id"]: r["fold"] for r in split.stratified_kfold(df, 4).collect()}
    keyed = split._keyed(df, 42, "row_id")
    ranked = split._stratified_by_rank(keyed, 4, "label", "row_id")
    assert {r["row_id"]: r["fold"] for r in ranked.collect()} == literal
    assert len(literal) == 100 and None not in literal.values()


def test_many_classes_use_ranks(spark):
    df = spark.range(1200).select(F.col("id").alias("row_id"), (F.col("id") % 600).alias("label"))
    got = split.stratified_kfold(df, 2).groupBy("label").agg(F.countDistinct("fold").alias("n"))
    assert got.where("n <> 2").count() == 0


def test_assigning_moves_no_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text", "lang")
    for out in (split.exact_split(df), split.kfold(df), split.stratified_kfold(df, label="lang")):
        assert "Exchange" not in planned(out) and "Join" not in planned(out)


def test_batches_rank_in_buckets(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    out = split.assign_batches(df, 16)
    assert not wide_single_partitions(out, ["text", "row_id"])
    sizes = [r["count"] for r in out.groupBy("batch_id").count().orderBy("batch_id").collect()]
    n = df.count()
    assert sizes == [16] * (n // 16) + ([n % 16] if n % 16 else [])
    first = {r["row_id"] for r in out.where("batch_id = 0").collect()}
    ids = [r["row_id"] for r in df.collect()]
    assert first == set(order(ids, "42:0")[:16])


def test_bucketed_rank_is_row_number(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"))
    keyed = df.withColumn("_key", shuffle_key(1, "row_id"))
    ranked = ranks.bucketed_rank(keyed, key_bucket(F.col("_key"), 1), ["_key", "row_id"], ["label"])
    plain = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("_key", "row_id")))
    assert plain.where("rn <> rank").count() == 0 and plain.count() == 3000


def test_block_rank_of_one_hot_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") * 3).alias("at"))
    got = ranks.block_rank(df, ["g"], "at", width=100).where("rank <> at / 3 + 1")
    assert got.count() == 0


def test_find_cuts_rows(spark):
    df = spark.range(500).select(F.col("id").alias("row_id")).withColumn("_key", shuffle_key(42, "row_id"))
    sizes, cuts = ranks.find_cuts(
        df, [key_bucket(F.col("_key"), 1)], ["_key", "row_id"], lambda s: {g: [0, 1, 250, 500] for g in s})
    assert sizes == {0: 500}
    assert cuts[0][0] is None
    assert [c[1] for c in cuts[0][1:]] == [order(range(500))[i] for i in (0, 249, 499)]


def test_distribution_and_sides(spark):
    df = spark.createDataFrame([(i, int(i > 7)) for i in range(10)], "row_id long, label int")
    folded = split.stratified_kfold(df, 5)
    rows = {(r["fold"], r["label"]): (r["n_train"], r["n_val"]) for r in split.fold_distribution(folded, 5).collect()}
    assert len(rows) == 10 and all(a + b == (2 if label else 8) for (_, label), (a, b) in rows.items())
    train, val = split.take_fold(folded, 1, "train"), split.take_fold(folded, 1)
    assert train.unionByName(val).exceptAll(folded).count() == 0 and train.count() + val.count() == 10
    with pytest.raises(ValueError):
        split.take_fold(folded, 1, "test")
    with pytest.raises(ValueError):
        split.kfold(df, 1)


def test_shuffled_changes_with_epoch(spark):
    df = spark.range(50).toDF("row_id")
    ids = lambda e: [r["row_id"] for r in split.shuffled(df, 42, e).collect()]
    assert ids(0) == order(range(50), "42:0") and ids(0) != ids(1)
