"""Exact top-k inner products by vector-approximation files.

Every dimension is cut into cells at quantiles of all vectors; a vector's approximation is
one byte per dimension. The approximations are stored once, packed into blocks. A search
scans these alone: the bounds of the cells give a lower and an upper bound of every score,
and per query the k-th highest lower bound over all blocks rules out every row whose upper
bound is below it. Only what is left is read exactly, joined by row number, and scored in
whole numbers. The result is exact whatever the cells.

Queries are packed into blocks as well; a block of approximations and one of queries meet
as one small unit of work. Rows are told apart by a stored number, not by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import bounded_batches, tidy
from textlab.operators.small import lookup_join
from textlab.sources.storage import materialize

CELLS = 64
SCALE = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
# Components of this size (no float has it) count as infinite: scaled they leave the doubles.
LIMIT = 1e300
# Cell bounds of at most so many vector lengths are shipped to every task.
_FEW_SIZES = 100
# Queries whose bounds are worked out together.
_TOGETHER = 128


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Floor of ``scale`` times each component, as doubles: they hold these whole numbers
    exactly. The product with a power of two is exact as well."""
    def one(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        # Doubles from 2**52 on are whole; the floor is a long.
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def cell_bounds(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """``size, edges``: per length of vector and dimension the cell bounds, that is minimum,
    quantiles, and a number above the maximum of the scaled components of all vectors."""
    each = rows.select("size", F.posexplode("ints").alias("dim", "x"))
    steps = [i / cells for i in range(1, cells)]
    bounds = each.groupBy("size", "dim").agg(
        F.min("x").alias("low"), F.max("x").alias("high"),
        F.percentile_approx("x", steps, 2000).alias("cuts"))
    inner = F.filter(F.array_distinct("cuts"), lambda c: c > F.col("low"))
    edges = F.concat(F.array("low"), F.array_sort(inner), F.array(F.col("high") + 1.0))
    return bounds.select("size", "dim", edges.alias("edges")).groupBy("size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "edges"))), lambda s: s["edges"]).alias("edges"))


# -- blocks -----------------------------------------------------------------

_BLOCK = "size int, block long, numbers binary, vectors binary"


def _packed(rows: DataFrame, per_block: int) -> DataFrame:
    """Rows of one length per block, in the order in which a task meets them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def block(size: int) -> pa.RecordBatch:
            nonlocal made
            numbers, vectors = held.pop(size)
            made += 1
            return pa.RecordBatch.from_pydict({
                "size": pa.array([size], pa.int32()), "block": pa.array([base + made], pa.int64()),
                "numbers": pa.array([np.array(numbers, "<i8").tobytes()], pa.binary()),
                "vectors": pa.array([np.array(vectors, "<f8").tobytes()], pa.binary())})

        for batch in batches:
            for number, size, ints in zip(*(batch[c].to_pylist() for c in ("number", "size", "ints"))):
                numbers, vectors = held.setdefault(size, ([], []))
                numbers.append(number)
                vectors.append(ints)
                # Few blocks are open at a time, however many lengths there are.
                if len(numbers) >= per_block or len(held) > _FEW_SIZES:
                    yield block(size)
        for size in list(held):
            yield block(size)

    return rows.select("number", "size", "ints").mapInArrow(pack, _BLOCK)


def approximate(vectors: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Cell of every component, one byte each."""
    out = np.empty(vectors.shape, np.uint8)
    for d, e in enumerate(edges):
        out[:, d] = np.searchsorted(e, vectors[:, d], "right") - 1
        # Above the last edge only if 1 is lost on a large maximum.
        np.minimum(out[:, d], len(e) - 2, out=out[:, d])
    return out


def _approximated(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["size"] or 1)
                cells = approximate(v, _arrays(row["edges"])).tobytes()
                yield pa.RecordBatch.from_pydict({
                    "size": pa.array([row["size"]], pa.int32()), "block": pa.array([row["block"]], pa.int64()),
                    "numbers": pa.array([row["numbers"]], pa.binary()), "cells": pa.array([cells], pa.binary())})

    return lookup_join(blocks, edges, "size", "left", _FEW_SIZES).mapInArrow(
        tidy(run), "size int, block long, numbers binary, cells binary")


def _arrays(edges: list | None) -> list[np.ndarray]:
    return [np.array(e) for e in edges or []]


# -- bounds -----------------------------------------------------------------

def score_bounds(cells: np.ndarray, queries: np.ndarray, edges: list[np.ndarray]):
    """Lower and upper bounds of the scores: (queries, rows). They give way by more than
    the rounding of doubles can be wrong."""
    if not edges:
        zero = np.zeros((len(queries), len(cells)))
        return zero, zero
    width = max(len(e) for e in edges)
    low, high = np.zeros((len(edges), width)), np.zeros((len(edges), width))
    for d, e in enumerate(edges):
        low[d, : len(e) - 1], high[d, : len(e) - 1] = e[:-1], e[1:]
    at = np.arange(len(edges))
    lows, highs = low[at, cells], high[at, cells]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    lower, upper = plus @ lows.T + minus @ highs.T, plus @ highs.T + minus @ lows.T
    size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).max(axis=1)
    slack = (1.0 + size * 1e-9)[:, None]
    return lower - slack, upper + slack


def survivors(
    numbers: np.ndarray, cells: np.ndarray, query_numbers: np.ndarray, queries: np.ndarray,
    edges: list[np.ndarray], k: int,
) -> Iterator[tuple[np.ndarray, ...]]:
    """Per some queries ``query, row, lower, upper`` of the rows of a block that may be among
    the best k: those whose upper bound is not below the k-th highest lower bound here."""
    for at in range(0, len(queries), _TOGETHER):
        asks = query_numbers[at : at + _TOGETHER]
        with np.errstate(over="ignore", invalid="ignore"):
            lower, upper = score_bounds(cells, queries[at : at + _TOGETHER], edges)
        # Bounds that left the doubles rule nothing out.
        lower[~np.isfinite(lower)], upper[~np.isfinite(upper)] = -np.inf, np.inf
        own = asks[:, None] == numbers[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        floor = np.full(len(asks), -np.inf)
        if len(numbers) > k:
            floor = np.partition(lower, len(numbers) - k, axis=1)[:, len(numbers) - k]
        q, r = np.nonzero((upper >= floor[:, None]) & ~own)
        yield asks[q], numbers[r], lower[q, r], upper[q, r]


def _scan(approximations: DataFrame, asked: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Every block of approximations with every block of queries of its length."""
    counts = asked.groupBy("size").agg(F.count(F.lit(1)).alias("n_asked"))
    blocks = approximations.groupBy("size").agg(F.count(F.lit(1)).alias("n_blocks"))

    def numbered(df: DataFrame) -> DataFrame:
        """Blocks of a length counted through by their order."""
        at = Window.partitionBy("size").orderBy("block")
        place = df.select("size", "block").withColumn("place", F.row_number().over(at) - 1)
        return df.join(place, ["size", "block"])

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))

    left = lookup_join(numbered(approximations), counts, "size", limit=_FEW_SIZES).select(
        "size", "numbers", "cells", F.col("place").alias("b"), every("n_asked").alias("q"))
    right = lookup_join(numbered(asked), blocks, "size", limit=_FEW_SIZES).select(
        "size", F.col("numbers").alias("asks"), "vectors", F.col("place").alias("q"), every("n_blocks").alias("b"))
    pairs = lookup_join(left.join(right, ["size", "b", "q"]), edges, "size", "left", _FEW_SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["size"]
                numbers, asks = np.frombuffer(row["numbers"], "<i8"), np.frombuffer(row["asks"], "<i8")
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(numbers), d)
                queries = np.frombuffer(row["vectors"], "<f8").reshape(len(asks), d)
                for found in survivors(numbers, cells, asks, queries, _arrays(row["edges"]), k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in found], names=["query", "number", "lower", "upper"])

    return pairs.select("size", "numbers", "cells", "asks", "vectors", "edges").mapInArrow(
        tidy(run), "query long, number long, lower double, upper double")


# -- exact scores -----------------------------------------------------------

def _order_key(score: int) -> bytes:
    """Bytes that sort like the numbers, whatever their size."""
    digits = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    body = len(digits).to_bytes(2, "big") + digits
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - b for b in body)


def _scores(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a, b in zip(batch["asks"].to_pylist(), batch["ints"].to_pylist()):
                x, y = np.array(a), np.array(b)
                # Sums of whole numbers are exact in doubles below 2**53.
                if float(np.abs(x) @ np.abs(y)) < 1 << 52:
                    scores.append(int(x @ y))
                else:
                    scores.append(sum(int(u) * int(v) for u, v in zip(a, b)))
            yield pa.RecordBatch.from_arrays([
                batch["query"], batch["query_id"], batch["vec_id"],
                pa.array([s if -(1 << 63) <= s < 1 << 63 else None for s in scores], pa.int64()),
                pa.array([_order_key(s) for s in scores], pa.binary()),
            ], names=["query", "query_id", "vec_id", "score", "key"])

    return pairs.select("query", "query_id", "vec_id", "asks", "ints").mapInArrow(
        run, "query long, query_id long, vec_id long, score long, key binary")


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id",
    embedding: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` that meets the
    condition ``queries``, the ``k`` other rows with the highest integer inner product.

    Scores are inner products of the components scaled by 256 and rounded down, exact at any
    size; one that does not fit a long is null, its rank right all the same. Ties go to the
    smaller id; fewer than k other rows give fewer results. Null vectors and those with null
    or non-finite components take no part, nor do rows without an id; vectors meet only
    those of the same length (empty ones too: their scores are 0). Repeated ids: every row
    asks for itself, and all rows but itself answer.
    """
    bounded_batches(vectors.sparkSession)
    finite = F.forall(embedding, lambda x: F.abs(x.cast("double")) < LIMIT)
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).where(finite).select(
        F.monotonically_increasing_id().alias("number"), F.col(vec_id).cast("bigint").alias("vec_id"),
        F.coalesce(queries, F.lit(False)).alias("is_query"),
        scaled(F.col(embedding)).alias("ints"), F.size(embedding).alias("size"))
    rows = materialize(rows, "va_rows")
    edges = materialize(cell_bounds(rows), "va_edges")
    approximations = materialize(_approximated(_packed(rows, block_rows), edges), "va_cells")
    asked = materialize(_packed(rows.where("is_query"), query_rows), "va_queries")
    found = materialize(_scan(approximations, asked, edges, k), "va_survivors")
    # The k-th highest lower bound of a query over all blocks.
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    floor = found.select("query", "lower").withColumn("at", F.row_number().over(best)).where(
        F.col("at") <= k).groupBy("query").agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n"))
    floor = floor.select("query", F.when(F.col("n") < k, float("-inf")).otherwise(F.col("least")).alias("least"))
    left = found.join(floor, "query").where("upper >= least").select("query", "number")
    asks = rows.where("is_query").select(
        F.col("number").alias("query"), F.col("vec_id").alias("query_id"), F.col("ints").alias("asks"))
    pairs = left.join(rows.select("number", "vec_id", "ints"), "number").join(asks, "query")
    w = Window.partitionBy("query").orderBy(F.desc("key"), "vec_id")
    return _scores(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
