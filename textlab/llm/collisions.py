"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on many random directions. For a pair with the threshold cosine
the difference of the two values on one direction is a centred normal, so a window of
``reach`` deviations around a query's value holds the partner with a known probability.
The number of directions on which two vectors collide is then binomial, and the count a
pair must pass is the largest one that keeps the wanted recall. Pairs that pass are
verified by their cosine.

Vectors are sorted along the first direction and cut into strips of equal numbers of
vectors. Two strips meet in one task if a window of the one reaches into the other; a task
counts collisions of small blocks of pairs, and returns per vector its number of links and
one representative it is linked to, never the pairs. Equal vectors are one weighted vector.

A strip holds a fixed share of a larger table, up to ``STRIP_BYTES``, so until then a vector
is copied a bounded number of times; copies are sent in batches of a few megabytes, however
many there are. Blocks are counted on projections rounded to bytes, which lose no collision,
and what passes is counted again exactly, a bounded number of pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import BATCH_BYTES, bounded_batches, components, give_back, tidy
from textlab.sources.storage import materialize

COSINE = 0.95
DIRECTIONS = 24
# Half width of a window in standard deviations at the threshold.
REACH = 3.0
RECALL = 0.995
# Rows of a strip at least; a larger table has _STRIPS of them until the unit vectors of a
# strip take STRIP_BYTES.
STRIP_ROWS = 4096
STRIP_BYTES = 32 << 20
_STRIPS = 8
# Directions counted for all pairs of a block before pairs are listed.
_DENSE = 16
_BLOCK = 256
_TILE = 4096
# Steps of a rounded projection in the half width of a window.
_STEPS = 32
# Bytes of projections or vectors gathered for listed pairs at a time.
_LISTED_BYTES = 8 << 20


def half_width(cosine: float = COSINE, reach: float = REACH) -> float:
    return reach * sqrt(2 - 2 * cosine)


def calibrated_count(
    directions: int = DIRECTIONS, reach: float = REACH, recall: float = RECALL
) -> int:
    """Largest count that a pair at the threshold cosine passes with probability
    ``recall``; more similar pairs pass more often."""
    p = erf(reach / sqrt(2))
    total = 0.0
    for count in range(directions, 0, -1):
        total += comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if total >= recall:
            return count
    raise ValueError("no count gives that recall")


def _directions(n: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, size))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _wide(width: float) -> float:
    """A half width in which rounding never loses a collision."""
    return width * (1 + 1e-5) + 1e-5


def _codes(values: np.ndarray, width: float) -> np.ndarray:
    """Projections in steps of a ``_STEPS``-th of ``width``, modulo 256, a row for each
    direction. Values that collide differ by at most ``_STEPS`` steps; others may seem to."""
    step = _wide(width) / _STEPS
    codes = np.empty(values.shape[::-1], np.uint8)
    for k, row in enumerate(codes):
        row[:] = np.floor(values[:, k] / step).astype(np.int64) & 255
    return codes


def linked_pairs(
    left: np.ndarray, right: np.ndarray, same: bool, cosine: float, width: float,
    count: int, seed: int, directions: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the linked pairs between two sets of unit vectors, block by block;
    ``same``: the sets are one, and only pairs i < j count."""
    axes = _directions(directions, left.shape[1], seed)
    a, b = left @ axes.T, right @ axes.T
    by_a, by_b = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    along_a, along_b = a[by_a, 0], b[by_b, 0]
    codes_a, codes_b = _codes(a[by_a], width) + np.uint8(_STEPS), _codes(b[by_b], width)
    miss_most = directions - count
    apart, over, missed = (np.empty(_BLOCK * _TILE, kind) for kind in (np.uint8, bool, np.uint8))
    listed = max(1, _LISTED_BYTES // (8 * max(left.shape[1], directions)))
    for at in range(0, len(by_a), _BLOCK):
        to = min(at + _BLOCK, len(by_a))
        # Of one set, a pair is counted at the query that comes first.
        first = at if same else np.searchsorted(along_b, along_a[at] - width, "left")
        last = np.searchsorted(along_b, along_a[to - 1] + width, "right")
        for low in range(first, last, _TILE):
            high = min(low + _TILE, last)
            shape, n = (to - at, high - low), (to - at) * (high - low)
            d, o, m = apart[:n].reshape(shape), over[:n].reshape(shape), missed[:n].reshape(shape)
            m[:] = 0
            for k in range(min(_DENSE, directions)):
                np.subtract(codes_a[k, at:to, None], codes_b[k, low:high], out=d)
                np.greater(d, 2 * _STEPS, out=o)
                np.add(m, o.view(np.uint8), out=m)
            near = np.flatnonzero(np.less_equal(missed[:n], miss_most, out=over[:n]))
            for some in range(0, len(near), listed):
                i, j = np.divmod(near[some : some + listed], high - low)
                i, j = i + at, j + low
                if same:
                    i, j = i[i < j], j[i < j]
                i, j = by_a[i], by_b[j]
                hits = (np.abs(a[i] - b[j]) <= width).sum(axis=1)
                i, j = i[hits >= count], j[hits >= count]
                close = np.einsum("ij,ij->i", left[i], right[j]) >= cosine
                i, j = i[close], j[close]
                if len(i):
                    yield (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while (above := self.parent[self.parent]) is not self.parent and (above != self.parent).any():
            self.parent = above
        return self.parent

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        roots = self.roots()
        i, j = roots[i], roots[j]
        pairs = np.unique(np.stack([i[i != j], j[i != j]], axis=1), axis=0)
        for x, y in pairs.tolist():
            while self.parent[x] != x:
                x = self.parent[x]
            while self.parent[y] != y:
                y = self.parent[y]
            self.parent[max(x, y)] = min(x, y)


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~bad & some, F.lit(False))


def _units(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The unit vectors of an Arrow column of lists of ``size`` numbers."""
    unit, at = np.empty((len(vectors), size)), 0
    for chunk in vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]:
        if len(chunk):
            flat = chunk.flatten().cast(pa.float64(), safe=False)
            unit[at : at + len(chunk)] = _unit(flat.to_numpy(zero_copy_only=False).reshape(-1, size))
            at += len(chunk)
    return unit


def strip_size(n: int, size: int) -> int:
    """Rows of a strip of ``n`` vectors with ``size`` components."""
    return max(STRIP_ROWS, min(n // _STRIPS, STRIP_BYTES // (8 * size)))


def _strips(nodes: DataFrame, size: int, rows: int | None, seed: int) -> np.ndarray:
    """Cuts along the first direction into strips of about ``rows`` vectors: strip s holds
    cuts[s - 1] <= x <= cuts[s]."""
    axis = _directions(DIRECTIONS, size, seed)[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            if f.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_units(f.column("vector"), size) @ axis)], ["x"])

    values = nodes.select("vector").mapInArrow(tidy(project), "x double")
    n = nodes.count()
    strips = -(-n // (rows or strip_size(n, size)))
    steps = [i / strips for i in range(1, strips)]
    if not steps:
        return np.array([])
    return np.array(values.agg(F.percentile_approx("x", steps, max(10_000, 10 * strips))).first()[0])


def _strip_of(x: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The strip of each vector; those right on a cut, or on several equal ones, are dealt
    by number to the strips around it."""
    low, high = np.searchsorted(cuts, x, "left"), np.searchsorted(cuts, x, "right")
    return low + node % (high - low + 1)


def _copies(
    nodes: pa.RecordBatch, x: np.ndarray, cuts: np.ndarray, width: float, rows: int
) -> Iterator[pa.RecordBatch]:
    """A copy of each vector for every pair of strips ``a <= b`` in which its window meets
    others, in batches of at most ``rows``."""
    strip = _strip_of(x, nodes.column("node").to_numpy(), cuts)
    wide = _wide(width)
    first, last = np.searchsorted(cuts, x - wide, "left"), np.searchsorted(cuts, x + wide, "right")
    ends = np.cumsum(last - first + 1)
    for at in range(0, int(ends[-1]) if len(ends) else 0, rows):
        number = np.arange(at, min(at + rows, ends[-1]))
        row = np.searchsorted(ends, number, "right")
        s, other = strip[row], last[row] - (ends[row] - 1 - number)
        given = nodes.take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(s, other)), pa.array(np.maximum(s, other)), pa.array(s <= other),
             *(given.column(c) for c in ("node", "weight", "vector"))],
            ["a", "b", "left", "node", "weight", "vector"])


def links(
    nodes: DataFrame, size: int, cosine: float = COSINE, directions: int = DIRECTIONS,
    reach: float = REACH, recall: float = RECALL, strip_rows: int | None = None, seed: int = 23,
) -> DataFrame:
    """``node, n_links, other``: per task, the links found for a vector (weighted by how
    often the partner occurs) and one vector of its group there. ``nodes`` has ``node,
    weight, vector`` with distinct vectors of one length."""
    width, count = half_width(cosine, reach), calibrated_count(directions, reach, recall)
    cuts = _strips(nodes, size, strip_rows, seed)
    axis = _directions(directions, size, seed)[0]
    sent = max(1, BATCH_BYTES // (8 * size + 40))  # rows of a batch

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            yield from _copies(f, _units(f.column("vector"), size) @ axis, cuts, width, sent)

    def met(f: pa.Table) -> pa.Table:
        same = f["a"][0].as_py() == f["b"][0].as_py()
        node, weight = f["node"].to_numpy(), f["weight"].to_numpy()
        is_left = f["left"].to_numpy()
        l, r = np.flatnonzero(is_left), np.flatnonzero(is_left if same else ~is_left)
        n_links, forest = np.zeros(len(node), np.int64), _Forest(len(node))
        if len(l) and len(r):
            left = _units(f["vector"].filter(f["left"]), size)
            right = left if same else _units(f["vector"].filter(pa.array(~is_left)), size)
            for i, j in linked_pairs(left, right, same, cosine, width, count, seed, directions):
                i, j = l[i], r[j]
                np.add.at(n_links, i, weight[j])
                np.add.at(n_links, j, weight[i])
                forest.join(i, j)
        hit = np.flatnonzero(n_links)
        return pa.table({"node": node[hit], "n_links": n_links[hit],
                         "other": node[forest.roots()[hit]]})

    def meet(f: pa.Table) -> pa.Table:
        found = met(f)
        give_back()
        return found

    vector = nodes.schema["vector"].dataType.simpleString()
    dealt = nodes.mapInArrow(
        tidy(deal), f"a long, b long, left boolean, node long, weight long, vector {vector}")
    return dealt.groupBy("a", "b").applyInArrow(meet, "node long, n_links long, other long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
    cosine: float = COSINE, **options,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    ``n_links`` counts the other rows with a cosine of at least ``cosine`` that were found
    (see ``calibrated_count`` for the recall; no pair below is linked), ``component_id`` is
    the smallest id reachable by links, and ``kept`` says that it is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different length. Equal vectors are linked; a repeated row counts as
    often as it occurs. Rows with a null id take part; with no id in reach their component
    is null and they are kept.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    good, bad = rows.where(usable(F.col("vector"))), rows.where(~usable(F.col("vector")))
    # Stored with their number, so that it is the same wherever it is used.
    nodes = materialize(
        good.groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("node"), "weight", "least", "vector",
                F.size("vector").alias("size")), "collision_nodes")
    found = vectors.sparkSession.createDataFrame([], "node long, n_links long, other long")
    for r in nodes.select("size").distinct().collect():  # lengths of vectors: commonly one
        part = nodes.where(F.col("size") == r["size"]).select("node", "weight", "vector")
        found = found.unionByName(links(part, r["size"], cosine, **options))
    found = materialize(found, "collision_links")
    label = components(
        found.select(F.col("node").alias("src"), F.col("other").alias("dst")), "collision_components")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    marked = (
        nodes.join(counts, "node", "left").join(label, "node", "left")
        .withColumn("label", F.coalesce("component", "node"))
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1)
    )
    ids = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    known = marked.join(ids, "label").select("vector", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    linked = good.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = bad.select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                       F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept)
