import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from textlab.llm import collisions


def slow(rows, cosine=0.95):
    good = [n for n, (_, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = {n: 0 for n in range(len(rows))}, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in good:
        for b in good:
            v, w = rows[a][1], rows[b][1]
            if a < b and len(v) == len(w):
                dot = sum(x * y for x, y in zip(v, w))
                if dot / math.sqrt(sum(x * x for x in v) * sum(x * x for x in w)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, links[n], least.get(root(n))) for n, (i, _) in enumerate(rows)), key=repr)


def clustered(rng, n, size):
    centres = [np.array([rng.gauss(0, 1) for _ in range(size)]) for _ in range(n)]
    rows = []
    for c in centres:
        for _ in range(rng.choice([1, 1, 2, 5])):
            noise = np.array([rng.gauss(0, 1) for _ in range(size)])
            rows.append((c * rng.uniform(0.1, 9) + noise * rng.choice([0, 0.01, 0.1])).tolist())
    return rows


@pytest.mark.parametrize("strip_rows", [4096, 20])
def test_by_brute_force(spark, strip_rows):
    rng = random.Random(strip_rows)
    rows = [(i, v) for i, v in enumerate(clustered(rng, 60, 32))]
    hot = [1.0] + [0.0] * 31
    rows += [(1000 + i, hot if i % 2 else [2.0, rng.gauss(0, 1e-3)] + [0.0] * 30) for i in range(90)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [math.nan] * 32), (2004, [None] * 32),
             (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (None, hot), (None, [-3.0, 1.0]), (3, rows[3][1]),
             (2007, [1e300] * 32), (2008, [1e-300] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n_links")
    got = collisions.near_duplicates(df, strip_rows=strip_rows).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == slow(
        [(i, v and [x * 1e-200 if x == 1e300 else x * 1e200 if x == 1e-300 else x for x in v]
          if v and v[0] in (1e300, 1e-300) else v) for i, v in rows])
    assert all(r.kept == (r.vec_id == r.component_id or r.component_id is None) for r in got)


def test_recall_at_the_threshold():
    """Pairs right at the threshold are found as often as calibrated."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9501
    b = c * a + math.sqrt(1 - c * c) * b
    both = np.concatenate([a, b])
    found = set()
    for i, j in collisions.linked_pairs(
            both, both, True, 0.95, collisions.half_width(), collisions.calibrated_count(), 23,
            collisions.DIRECTIONS):
        found.update(zip(i.tolist(), j.tolist()))
    hits = sum((i, i + 2000) in found for i in range(2000))
    assert hits >= 0.99 * 2000


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert collisions.near_duplicates(df).count() == 0


def near_copies(rng, n, size=64, noise=0.01):
    v = rng.standard_normal(size) + noise * rng.standard_normal((n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("same", [True, False])
def test_a_group_of_near_copies_takes_bounded_memory(same):
    rng = np.random.default_rng(4)
    left = near_copies(rng, 1500)
    right = left if same else left[:700]
    tracemalloc.start()
    try:
        found = sum(len(i) for i, _ in collisions.linked_pairs(
            left, right, same, 0.95, collisions.half_width(), collisions.calibrated_count(), 23,
            collisions.DIRECTIONS))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == (1500 * 1499 // 2 if same else 1500 * 700)
    assert peak < 100e6  # 209 MB and 193 MB when all pairs of a block were listed at once


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("tile", [5, 4096])
def test_pairs_of_rounded_projections(monkeypatch, same, tile):
    """Every pair that collides often enough, on the first direction too, and no other."""
    monkeypatch.setattr(collisions, "_TILE", tile)
    monkeypatch.setattr(collisions, "_BLOCK", 7)
    monkeypatch.setattr(collisions, "_LISTED_BYTES", 3 * 8 * 24)
    rng = np.random.default_rng(tile)
    left = np.concatenate([near_copies(rng, 12, 16, noise) for noise in (0, 0.1, 0.15, 0.2, 0.3, 9)])
    right = left if same else np.concatenate([left[::3], near_copies(rng, 20, 16, 3)])
    width, count, cosine = collisions.half_width(), collisions.calibrated_count(), 0.95
    axes = collisions._directions(24, 16, 23)
    apart = np.abs((left @ axes.T)[:, None] - (right @ axes.T)[None])
    linked = ((apart <= width).sum(axis=2) >= count) & (left @ right.T >= cosine)
    if same:
        linked &= np.arange(len(left))[:, None] < np.arange(len(left))
    want = set(zip(*(x.tolist() for x in np.nonzero(linked & (apart[:, :, 0] <= width)))))
    found = [(i, j) for x, y in collisions.linked_pairs(left, right, same, cosine, width, count, 23, 24)
             for i, j in zip(x.tolist(), y.tolist())]
    assert len(want) > 50 and len(found) == len(set(found))
    assert want <= set(found) <= set(zip(*(x.tolist() for x in np.nonzero(linked))))


def test_copies_for_many_strips_are_sent_in_small_batches():
    n, cuts, width = 40, np.linspace(-3, 3, 3000), 1.0
    x = np.random.default_rng(5).uniform(-4, 4, n)
    strip = np.searchsorted(cuts, x)
    nodes = pa.RecordBatch.from_pydict({
        "node": list(range(n)), "weight": [1] * n, "vector": [[float(k)] for k in range(n)]})
    batches = list(collisions._copies(nodes, x, cuts, width, 512))
    assert max(b.num_rows for b in batches) == 512
    copies = [r for b in batches for r in b.to_pylist()]
    assert all(r["vector"] == [r["node"]] and r["a"] <= r["b"] for r in copies)
    assert all(r["left"] == (r["a"] == strip[r["node"]]) for r in copies)
    met = {(r["node"], r["a"] + r["b"] - strip[r["node"]]) for r in copies}
    assert len(met) == len(copies)
    lows, highs = np.append(-np.inf, cuts), np.append(cuts, np.inf)
    for k in range(n):  # the strips that the window reaches
        reached = np.flatnonzero((lows <= x[k] + width) & (highs >= x[k] - width))
        assert {b for a, b in met if a == k} == set(reached.tolist())
    assert not list(collisions._copies(nodes.slice(0, 0), x[:0], cuts, width, 512))


def test_strips_of_larger_tables():
    assert collisions.strip_size(30_000, 64) == 4096
    assert collisions.strip_size(400_000, 64) == 50_000
    assert collisions.strip_size(10**9, 64) == 65_536
    assert collisions.strip_size(10**9, 8192) == 4096
    cuts = np.array([-1.0, 0.5, 0.5, 0.5, 2.0])
    strips = collisions._strip_of(np.full(4000, 0.5), np.arange(4000), cuts)
    assert np.bincount(strips).tolist() == [0, 1000, 1000, 1000, 1000]
    assert collisions._strip_of(np.array([-3, 0.4, 0.6, 9]), np.arange(4), cuts).tolist() == [0, 1, 4, 5]


def test_multiples_of_one_vector(spark):
    """Distinct vectors with one projection are in several strips."""
    rows = [(i, [2.0 ** (i - 40), 0.0, -(2.0 ** (i - 40))]) for i in range(80)]
    rows += [(100 + i, [1.0, float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collisions.near_duplicates(df, strip_rows=10).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == slow(rows)
