import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import vafile


def slow(rows, k, asks):
    """Every row that asks against every other row of its length, in whole numbers."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(good):
        if not asks(q):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(good)
                        if n != at and len(w) == len(v))
        fit = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
        out += [(q, n + 1, i, fit(-s)) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def fast(df, k, **options):
    return sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 50 == 0, k, **options).collect()), key=str)


@pytest.mark.parametrize("block_rows, k", [(10_000, 5), (40, 5), (7, 1)])
def test_by_brute_force(spark, block_rows, k):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5, -0.25, 1.0, 0.0, 0.0, 3.0]) for i in range(300, 420)]  # ties
    rows += [(500, None), (550, []), (551, []), (450, []), (600, [1.0, None] * 3), (650, [math.nan] * 6),
             (700, [math.inf] * 6), (750, [1.0, 2.0]), (751, [2.0, 1.0]), (None, [1.0] * 6),
             (800, [0.0] * 6), (850, [-200.0] * 6), (7, rows[7][1]), (1000, [5.0]),
             (50, [3.0] * 6), (50, rows[50][1]), (850, [-200.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS rank", "2 AS number", "3 AS size").repartition(3)
    assert fast(df, k, block_rows=block_rows, query_rows=4) == slow(rows, k, lambda i: i % 50 == 0)


@pytest.mark.parametrize("size", [2.0**18, 2.0**27, 2.0**50, 1e37])
def test_large_components(spark, size):
    rng = random.Random(1)
    rows = [(50, [1.0, 2.0]), (1, [300_000.0, 1.0]), (2, [1.0, 1.0])]
    rows += [(i, [rng.gauss(0, size), rng.gauss(0, 1)]) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert fast(df, 3, block_rows=16) == slow(rows, 3, lambda i: i % 50 == 0)


def test_few_rows_are_read_exactly():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(0, 1, (4000, 16)))
    edges = [np.concatenate([np.quantile(v, np.arange(64) / 64), [v.max() + 1]]) for v in vectors.T]
    cells = vafile.approximate(vectors, edges)
    kept = list(vafile.survivors(np.arange(4000), cells, np.arange(50), vectors[:50], edges, 5))
    assert sum(len(x[0]) for x in kept) < 50 * 400
    for q in range(50):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores)[:5].tolist())
        assert best <= {int(r) for x in kept for a, r in zip(x[0], x[1]) if a == q}


def test_keys_sort_like_numbers():
    numbers = sorted([0, 1, -1, 255, 256, -256, -255, 2**63, -(2**63), 10**90, -(10**90), 10**90 + 1])
    assert sorted(numbers, key=vafile._order_key) == numbers


def test_no_rows_or_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert vafile.top_k(df.limit(0), F.lit(True)).count() == 0
    assert vafile.top_k(df, F.col("vec_id") == 2).count() == 0
    assert vafile.top_k(df, F.lit(True)).count() == 0  # no other row


def test_more_lengths_than_are_shipped(spark, monkeypatch):
    monkeypatch.setattr(vafile, "_FEW_SIZES", 2)
    rows = [(i, [float(i % 7 - 3)] * (i % 6)) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert fast(df, 2) == slow(rows, 2, lambda i: i % 50 == 0)
