"""What several of these operators share: words and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.sources.storage import materialize

# A word is a run of anything but space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Send Python workers at most ``BATCH_BYTES`` of texts at a time (a session setting;
    a single longer row still goes in one piece)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return memory that this Python worker no longer uses to the system. Workers outlive
    their tasks and wait for the next stage; without this each keeps its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over the batches of a task that gives its memory back at the end."""
    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph given as ``src, dst`` longs.

    Returns ``node, component`` for every node with an edge to another one; the component
    is its smallest node. Alternates large-star and small-star steps until the edge set is
    a set of stars, so a chain of n nodes takes O(log n) rounds. Minima are aggregated
    before the shuffle and joined back, so a node with very many edges is never gathered
    in one task. Each round is stored, which cuts the lineage and survives lost executors.
    Self loops, repeated and null edges are ignored; an empty input gives an empty result.
    """
    now = materialize(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(), name,
    )
    state = _state(now)
    while state[0]:
        now = materialize(_small_star(_large_star(now)), name)
        before, state = state, _state(now)
        if before == state:
            break
    stars = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("digest"),
    ).first()
    return row["n"], row["digest"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("low"))
    low = low.select("src", F.least("src", "low").alias("low"))
    return (
        both.where(F.col("dst") > F.col("src")).join(low, "src")
        .select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    hung = edges.join(low, "src").where(F.col("dst") != F.col("low"))
    return (
        hung.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .unionByName(low.select("src", F.col("low").alias("dst"))).distinct()
    )
