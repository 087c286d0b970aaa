"""Exact integer k-means by heap-ordered bounds.

After a vector has been compared with all centroids, the gap between its second best and
its best distance says how far centroids may move before its cluster can change. Per block
of vectors and cluster a heap holds these gaps, each plus the cluster's accumulated drift
at that time: the centroid's own movement and the largest movement of any other one, summed
over the rounds. In a later round only vectors at the top of a heap whose entry is below
the drift by now have run out; they are popped, compared exactly with all centroids and
pushed again. Nothing is done for the others, and the sums of the clusters change only by
the vectors that move.

Distances are exact integers. Bounds are doubles that are kept too small by more than they
can be wrong, so the bounds save work and never decide.

Vectors are stored once in blocks, bucketed by the task that wrote them; what a round knows
about a block (clusters and heaps, some 5 % of its vectors) is stored in the same buckets.
So a round joins both without an exchange, and starts from what the round before has
stored. The driver sees centroids only: k x width numbers.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.common import bounded_batches
from textlab.llm.vafile import usable
from textlab.sources.storage import fresh_path, materialize

SCALE = 1024
BLOCK_ROWS = 4096
# Vectors per bucket of the stored tables, about.
BUCKET_ROWS = 1 << 18
MAX_BUCKETS = 100_000
# Components of this size (no float has it) count as infinite: scaled they leave the doubles.
LIMIT = 1e300
_PARTIALS = 32


# -- one block --------------------------------------------------------------

def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids) of vectors given as doubles that hold whole
    numbers and centroids as Python integers: in doubles or longs where all sums fit, else
    in Python integers."""
    top = max(_largest(vectors), _largest(centroids))
    room = 4 * vectors.shape[1] * top * top
    if room < 1 << 53:
        c = centroids.astype(float)
        return (vectors * vectors).sum(axis=1)[:, None] - 2 * (vectors @ c.T) + (c * c).sum(axis=1)
    if room < 1 << 63:
        v, c = vectors.astype(np.int64), centroids.astype(np.int64)
        return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)
    v, c = integers(vectors), centroids
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def integers(x: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers as Python integers."""
    out = np.empty(x.shape, object)
    out.flat = [int(i) for i in x.flat]
    return out


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties) and a lower bound of the gap to the
    second nearest; distances outside of doubles' whole numbers have none."""
    best = distances.argmin(axis=1)
    if distances.shape[1] == 1:
        return best, np.full(len(best), np.inf)
    if distances.dtype == object:
        return best, np.full(len(best), -np.inf)
    root = np.sqrt(distances.astype(float))
    rows = np.arange(len(best))
    first = root[rows, best]
    root[rows, best] = np.inf
    second = root.min(axis=1)
    return best, second - first - 1e-9 * (first + second + 1)


@dataclass
class Block:
    """What a round leaves of a block: the cluster of every row and, per cluster, the heap
    of (gap + drift at that time, row)."""

    cluster: np.ndarray
    heaps: list[list[tuple[float, int]]]
    moved: dict[int, list] = field(default_factory=dict)  # cluster: [count, sums]

    def shift(self, cluster: int, rows: np.ndarray, sign: int) -> None:
        """Note that these vectors came to or left a cluster."""
        if not len(rows):
            return
        total = _column_sums(rows)
        count, sums = self.moved.get(cluster, (0, [0] * rows.shape[1]))
        self.moved[cluster] = [count + sign * len(rows), [a + sign * b for a, b in zip(sums, total)]]


def _column_sums(rows: np.ndarray) -> list[int]:
    if len(rows) * _largest(rows) < 1 << 53:
        return [int(x) for x in rows.sum(axis=0)]
    return [int(x) for x in integers(rows).sum(axis=0)]


def first_round(vectors: np.ndarray, centroids: np.ndarray) -> Block:
    cluster, gap = nearest(squared_distances(vectors, centroids))
    heaps: list[list] = []
    block = Block(cluster.astype(np.int32), heaps)
    for c in range(len(centroids)):
        rows = np.flatnonzero(cluster == c)
        heaps.append(list(zip(gap[rows].tolist(), rows.tolist())))
        heapq.heapify(heaps[c])
        block.shift(c, vectors[rows], 1)
    return block


def next_round(block: Block, vectors: np.ndarray, centroids: np.ndarray, drift: list[float]) -> int:
    """Bring a block up to date with moved centroids; returns how many rows ran out."""
    block.moved = {}
    expired = []
    for c, heap in enumerate(block.heaps):
        while heap and heap[0][0] <= drift[c]:
            expired.append(heapq.heappop(heap)[1])
    if not expired:
        return 0
    rows = np.array(sorted(expired))
    before = block.cluster[rows]
    after, gap = nearest(squared_distances(vectors[rows], centroids))
    block.cluster[rows] = after
    for c, g, row in zip(after.tolist(), gap.tolist(), rows.tolist()):
        heapq.heappush(block.heaps[c], (g + drift[c], row))
    changed = before != after
    for c in np.unique(np.concatenate([before[changed], after[changed]])).tolist():
        block.shift(c, vectors[rows[changed & (after == c)]], 1)
        block.shift(c, vectors[rows[changed & (before == c)]], -1)
    return len(rows)


# -- centroids on the driver ------------------------------------------------

class Centroids:
    """k centroids, the exact sums of their vectors, and the accumulated drift."""

    def __init__(self, start: np.ndarray):
        self.now = integers(start)
        self.drift = [0.0] * len(start)
        self.count = [0] * len(start)
        self.sums = [[0] * start.shape[1] for _ in start]

    def move(self, moved: dict[int, list]) -> None:
        """Add what the blocks report and move every non-empty centroid to the floor of
        its mean."""
        for c, (count, sums) in moved.items():
            self.count[c] += count
            self.sums[c] = [a + b for a, b in zip(self.sums[c], sums)]
        new = self.now.copy()
        for c, n in enumerate(self.count):
            if n:
                new[c] = [s // n for s in self.sums[c]]
        # Unlike its square the hypotenuse does not overflow; rounded up.
        step = [float(np.hypot.reduce(d)) * (1 + 1e-9) for d in (new - self.now).astype(float)]
        for c in range(len(new)):
            others = max((s for i, s in enumerate(step) if i != c), default=0.0)
            self.drift[c] += step[c] + others
        self.now = new

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
                for row in self.now]


# -- tables -----------------------------------------------------------------

_BLOCKS = "part int, block int, ids array<bigint>, vectors binary"
_STATE = "part int, block int, cluster binary, keys binary, rows binary, sizes array<int>, moved array<string>"


def _blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """One row per block of vectors: scaled and floored components as doubles, which hold
    every such number exactly."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, held, n = TaskContext.get().partitionId(), [], [], 0

        def block() -> pa.RecordBatch:
            whole = np.concatenate(held)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([n], pa.int32()),
                "ids": pa.array([ids], pa.list_(pa.int64())), "vectors": pa.array([_packed(whole)], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                rows = batch.slice(at, block_rows)
                values = rows[1].flatten().cast(pa.float64()).to_numpy().reshape(rows.num_rows, -1)
                held.append(np.floor(float(SCALE) * values))
                ids += rows[0].to_pylist()
                if len(ids) >= block_rows:
                    yield block()
                    ids, held, n = [], [], n + 1
        if ids:
            yield block()

    return vectors.mapInArrow(pack, _BLOCKS)


def _packed(whole: np.ndarray) -> bytes:
    """Four bytes per component where they fit, else eight; the first byte says which."""
    small = _largest(whole) < 1 << 31
    return (b"i" + whole.astype("<i4").tobytes()) if small else (b"f" + whole.astype("<f8").tobytes())


def _unpacked(data: bytes, width: int) -> np.ndarray:
    kind = "<i4" if data[:1] == b"i" else "<f8"
    return np.frombuffer(data, kind, offset=1).reshape(-1, width).astype(float)


def _state_row(part: int, at: int, block: Block) -> dict:
    keys = [np.array([k for k, _ in h], "<f8") for h in block.heaps]
    rows = [np.array([r for _, r in h], "<i4") for h in block.heaps]
    moved = [f"{c} {n} {' '.join(map(str, s))}" for c, (n, s) in sorted(block.moved.items())]
    return {"part": part, "block": at, "cluster": block.cluster.astype("<i4").tobytes(),
            "keys": b"".join(k.tobytes() for k in keys), "rows": b"".join(r.tobytes() for r in rows),
            "sizes": [len(h) for h in block.heaps], "moved": moved}


def _block_of(row: dict) -> Block:
    keys = np.frombuffer(row["keys"], "<f8").tolist()
    rows = np.frombuffer(row["rows"], "<i4").tolist()
    ends = np.concatenate(([0], np.cumsum(row["sizes"]))).tolist()
    heaps = [list(zip(keys[a:b], rows[a:b])) for a, b in zip(ends, ends[1:])]
    return Block(np.frombuffer(row["cluster"], "<i4").copy(), heaps)


def _at_rest(row: dict, drift: list[float]) -> bool:
    """Whether the root of every heap of a stored block is above the drift: nothing in it has
    run out, and its vectors need not be looked at."""
    keys, at = np.frombuffer(row["keys"], "<f8"), 0
    for size, moved in zip(row["sizes"], drift):
        if size and keys[at] <= moved:
            return False
        at += size
    return True


_STATE_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("cluster", pa.binary()), ("keys", pa.binary()),
    ("rows", pa.binary()), ("sizes", pa.list_(pa.int32())), ("moved", pa.list_(pa.string()))])


def _assign(blocks: DataFrame, model: Centroids, width: int, first: bool) -> DataFrame:
    """State of every block after assigning its vectors to the centroids."""
    now, drift = model.now.copy(), list(model.drift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not first and _at_rest(row, drift):
                    stays = {n: row[n] for n in _STATE_ARROW.names if n != "moved"}
                    yield pa.RecordBatch.from_pylist([stays | {"moved": []}], _STATE_ARROW)
                    continue
                vectors = _unpacked(row["vectors"], width)
                if first:
                    block = first_round(vectors, now)
                else:
                    block = _block_of(row)
                    next_round(block, vectors, now, drift)
                yield pa.RecordBatch.from_pylist([_state_row(row["part"], row["block"], block)], _STATE_ARROW)

    return blocks.drop("ids", "moved").mapInArrow(run, _STATE)


def _moves(state: DataFrame, spark: SparkSession) -> dict[int, list]:
    """Sum of what all blocks report, added up per task and again in a bounded number of
    rows before it reaches the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for lines in batch[0].to_pylist():
                _add_lines(total, lines)
        if total:
            lines = [f"{c} {n} {' '.join(map(str, s))}" for c, (n, s) in sorted(total.items())]
            yield pa.RecordBatch.from_arrays([pa.array([lines], pa.list_(pa.string()))], names=["moved"])

    reports = state.where(F.size("moved") > 0).select("moved").mapInArrow(add, "moved array<string>")
    total: dict[int, list] = {}
    for r in reports.repartition(_PARTIALS).mapInArrow(add, "moved array<string>").collect():
        _add_lines(total, r["moved"])
    return total


def _add_lines(total: dict[int, list], lines: list[str]) -> None:
    for line in lines:
        c, n, *sums = map(int, line.split())
        count, old = total.get(c, (0, [0] * len(sums)))
        total[c] = [count + n, [a + b for a, b in zip(old, sums)]]


class _Buckets:
    """Tables under the shared folder in the same buckets, known to the session while they
    are in use."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []

    def store(self, df: DataFrame) -> DataFrame:
        name = f"textlab_{uuid.uuid4().hex}"
        path = fresh_path(self.spark, "centroids")
        self.names.append(name)
        df.write.format("parquet").option("path", path).bucketBy(self.n, "part").saveAsTable(name)
        return self.spark.table(name)

    @contextmanager
    def in_use(self):
        """Joins by part and block may rely on buckets by part alone."""
        conf, key = self.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        before = conf.get(key, "true")
        conf.set(key, "false")
        try:
            yield self
        finally:
            conf.set(key, before)
            for name in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose id has the smallest SHA-256 with the seed, scaled."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "vec_id", "embedding").limit(k).collect()
    return np.floor(float(SCALE) * np.array([r["embedding"] for r in rows], float))


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3,
    vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every
    vector with ``width`` components, none null or non-finite; others are left out.

    Components are scaled by 1024 and rounded down. The ``k`` vectors whose ids have the
    smallest SHA-256 of ``seed:id`` are the first centroids (ties by id and components; rows
    without an id come last; with fewer vectors there are fewer centroids). Each round
    assigns all vectors to the nearest centroid by squared distance, the smaller number on
    ties, and moves non-empty centroids to the floor of the mean; a last assignment
    follows. All of it is exact. Repeated rows count as often as they occur. Distances and
    sums beyond a long are null, the clusters right all the same.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.where(usable(F.col("embedding")) & (F.size("embedding") == width))
    rows = rows.where(F.forall("embedding", lambda x: F.abs(x.cast("double")) < LIMIT))
    start = starts(rows, k, seed)
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid_sha256 string")
    if not len(start):
        return spark.createDataFrame([], schema)
    model = Centroids(start)
    n = min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_ROWS)))
    with _Buckets(spark, n).in_use() as buckets:
        blocks = buckets.store(_blocks(rows, block_rows))
        state = buckets.store(_assign(blocks, model, width, True))
        for at in range(rounds):
            model.move(_moves(state, spark))
            both = blocks.join(state.hint("shuffle_hash"), ["part", "block"])
            if at < rounds - 1:
                state = buckets.store(_assign(both, model, width, False))
        last = materialize(_distances(both if rounds else blocks, model, width, not rounds), "clusters")
    return last.join(F.broadcast(_inertia(last, model)), "cluster").select(*[
        f.split()[0] for f in schema.split(", ")])


def _distances(blocks: DataFrame, model: Centroids, width: int, first: bool) -> DataFrame:
    """Last assignment: one row per vector."""
    now, drift = model.now.copy(), list(model.drift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _unpacked(row["vectors"], width)
                if first:
                    block = first_round(vectors, now)
                else:
                    block = _block_of(row)
                    next_round(block, vectors, now, drift)
                distance = np.empty(len(vectors), object)
                for c in range(len(now)):
                    own = block.cluster == c
                    if own.any():
                        distance[own] = [int(d) for d in squared_distances(vectors[own], now[c : c + 1])[:, 0]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(block.cluster, pa.int32()),
                    pa.array([d if d < 1 << 63 else None for d in distance], pa.int64()),
                ], names=["vec_id", "cluster", "distance"])

    return blocks.drop("moved").mapInArrow(run, "vec_id long, cluster int, distance long")


def _inertia(rows: DataFrame, model: Centroids) -> DataFrame:
    """One row per cluster that has vectors: at most k."""
    sums = rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"),
        F.count_if(F.col("distance").isNull()).alias("beyond")).collect()

    def fitting(parts: list) -> int | None:
        total = sum(int(r["total"] or 0) for r in parts)
        return None if total >= 1 << 63 or any(r["beyond"] for r in parts) else total

    digests, whole = model.digests(), fitting(sums)
    table = [(r["cluster"], fitting([r]), whole, digests[r["cluster"]]) for r in sums]
    return rows.sparkSession.createDataFrame(
        table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
