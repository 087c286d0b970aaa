import hashlib
import math
import random

import numpy as np
import pytest

from textlab.llm import centroids


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def slow(rows, k=8, rounds=10, width=64, seed=3):
    """Whole numbers of any size, all vectors against all centroids."""
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] is not None and sha(f"{seed}:{r[0]}"), r[0], r[1]))
    now = [v for _, v in order[:k]]

    def nearest():
        out = []
        for i, v in good:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, x)), c) for c, x in enumerate(now))
            out.append((i, c, d, v))
        return out

    for _ in range(rounds):
        found = nearest()
        for c in range(len(now)):
            own = [v for _, at, _, v in found if at == c]
            if own:
                now[c] = tuple(sum(x) // len(own) for x in zip(*own))
    found = nearest()
    fit = lambda d: d if d < 1 << 63 else None
    sums = {}
    for _, c, d, _ in found:
        sums[c] = sums.get(c, 0) + d if fit(d) is not None and sums.get(c, 0) is not None else None
    whole = None if None in sums.values() else fit(sum(sums.values()))
    sums = {c: None if t is None else fit(t) for c, t in sums.items()}
    return sorted(((i, c, fit(d), sums[c], whole, sha(",".join(map(str, now[c])))) for i, c, d, _ in found),
                  key=str)


def run(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr(
        "*", "1 AS part", "2 AS block", "3 AS cluster").repartition(3)
    return sorted(map(tuple, centroids.cluster(df, **options).collect()), key=str)


def clouds(rng, n, width, spread=2.0):
    middles = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(9)]
    return [(i, [m + rng.gauss(0, 1) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("block_rows, rounds", [(7, 10), (50, 0), (4096, 1)])
def test_by_brute_force(spark, block_rows, rounds):
    rng = random.Random(block_rows)
    rows = clouds(rng, 300, 6)
    rows += [(1000 + i, [0.5] * 6) for i in range(40)]  # copies
    rows += [(7, rows[7][1]), (7, [0.0] * 6), (None, [1.0] * 6), (2000, None), (2001, []),
             (2002, [1.0] * 5), (2003, [1.0, None] * 3), (2004, [math.nan] * 6), (2005, [math.inf] * 6)]
    got = run(spark, rows, width=6, rounds=rounds, block_rows=block_rows)
    assert got == slow(rows, width=6, rounds=rounds)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5 - 2), float(i % 3 - 1)]) for i in range(60)]
    assert run(spark, rows, width=2, k=6, rounds=4) == slow(rows, width=2, k=6, rounds=4)


@pytest.mark.parametrize("size", [2.0**14, 2.0**30, 1e37])
def test_large_components(spark, size):
    rng = random.Random(4)
    rows = [(i, [x * size for x in v]) for i, v in clouds(rng, 60, 3)]
    rows += [(100 + i, v) for i, v in clouds(rng, 20, 3)]
    assert run(spark, rows, width=3, k=4, rounds=2) == slow(rows, width=3, k=4, rounds=2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.5])]
    assert run(spark, rows, "float", width=2, rounds=2) == slow(rows, width=2, rounds=2)
    assert run(spark, rows[:1], width=2, rounds=1) == slow(rows[:1], width=2, rounds=1)
    assert run(spark, [(1, None)], width=2) == []
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'textlab_%'").count() == 0


def test_only_expired_vectors_are_looked_at():
    rng = np.random.default_rng(1)
    vectors = np.floor(1024 * np.concatenate([rng.normal(m, 0.2, (500, 8)) for m in (-3, 0, 3)]))
    model = centroids.Centroids(vectors[[0, 500, 1000]])
    block = centroids.first_round(vectors, model.now)
    looked = []
    for _ in range(6):
        model.move(block.moved)
        looked.append(centroids.next_round(block, vectors, model.now, model.drift))
        full = centroids.squared_distances(vectors, model.now).argmin(axis=1)
        assert (block.cluster == full).all()
    assert max(looked) < 50


def test_blocks_at_rest():
    rng = np.random.default_rng(3)
    vectors = np.floor(1024 * np.concatenate([rng.normal(m, 0.1, (50, 4)) for m in (-3, 3)]))
    model = centroids.Centroids(vectors[[0, 50, 51]])
    block = centroids.first_round(vectors, model.now)
    row = centroids._state_row(0, 0, block)
    for drift in ([0.0] * 3, [1e9, 0.0, 0.0], [0.0, 0.0, 1e9], [1e9] * 3):
        again = centroids._block_of(row)
        assert centroids._at_rest(row, drift) == (centroids.next_round(again, vectors, model.now, drift) == 0)


def test_bounds_never_decide_on_a_long_walk():
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * rng.normal(0, 1, (800, 4)))
    model = centroids.Centroids(vectors[:8])
    block = centroids.first_round(vectors, model.now)
    expired = 0
    for _ in range(40):
        model.move(block.moved)
        expired += centroids.next_round(block, vectors, model.now, model.drift)
        full = centroids.squared_distances(vectors, model.now).argmin(axis=1)
        assert (block.cluster == full).all()
        assert sorted(r for h in block.heaps for _, r in h) == list(range(800))
        assert [(full == c).sum() for c in range(8)] == [
            n + block.moved.get(c, [0])[0] for c, n in enumerate(model.count)]
    assert expired < 40 * 800 / 2
