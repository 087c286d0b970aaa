"""Exact ranks and cuts of large tables without sorting them in one task.

Rows are put into buckets that are ordered like the sort key. A count per bucket
gives every bucket's offset, and only rows of one bucket are ever ranked together.
When just a few cut points are needed, only the buckets holding them are ranked and
the table itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.small import rows_if_small

# Cuts are compared as literals in one expression up to this many.
MAX_LITERAL_CUTS = 512


def bucket_offsets(counts: DataFrame, by: Sequence[str], bucket: str, n: str) -> DataFrame:
    """Adds ``_before``: rows in earlier buckets of the same group. The window runs over
    the count table, which holds one row per bucket, not per input row."""
    w = Window.partitionBy(*by).orderBy(bucket)
    return counts.withColumn("_before", F.sum(n).over(w) - F.col(n))


def bucketed_rank(
    df: DataFrame, bucket: Column, order: Sequence[str], by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """1-based rank within ``by`` in the order of ``order`` (all ascending).

    ``bucket`` must not decrease along that order. Window and join share one hash
    partitioning on (group, bucket), so rows are shuffled once; null groups count as a
    group because the group travels as a struct.
    """
    group = F.struct(*by) if by else F.lit(0)
    keyed = df.withColumn("_group", group).withColumn("_bucket", bucket)
    counts = keyed.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = bucket_offsets(counts, ["_group"], "_bucket", "_n").drop("_n")
    inside = Window.partitionBy("_group", "_bucket").orderBy(*order)
    return (
        keyed.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
        .join(offsets, ["_group", "_bucket"])
        .select(*[keyed[c] for c in df.columns], (F.col("_before") + F.col("_rn")).alias(name))
    )


def block_rank(
    df: DataFrame, by: Sequence[str], order: str, width: int = 65_536, name: str = "rank"
) -> DataFrame:
    """Rank within ``by`` along a unique integer column, in blocks of ``width`` values,
    so that one very long group is spread over many tasks."""
    return bucketed_rank(df, F.floor(F.col(order) / F.lit(width)), [order], by, name)


# -- cut points -------------------------------------------------------------

def beyond(order: Sequence[str], cut: Sequence[Any]) -> Column:
    """Lexicographic ``order > cut``."""
    def step(tail: Column, pair: tuple[str, Any]) -> Column:
        col, value = F.col(pair[0]), F.lit(pair[1])
        return (col > value) | ((col == value) & tail)

    pairs = list(zip(order, cut))
    return reduce(step, reversed(pairs), F.lit(False))


def find_cuts(
    df: DataFrame,
    buckets: Sequence[Column],
    order: Sequence[str],
    targets: Callable[[dict[Any, int]], dict[Any, list[int]]],
    by: str | None = None,
) -> tuple[dict[Any, int], dict[Any, list[tuple | None]]] | None:
    """Rows standing at given ranks of each group.

    ``targets`` maps the group sizes to the wanted ranks. ``buckets`` narrow the search
    step by step: each must not decrease along ``order`` among rows that agree in the
    earlier ones, and only rows that agree in all of them are ranked together. Returns
    the group sizes and, per group, the order values at each rank (None for a rank below
    one), or None when there are too many groups or cuts for literals; callers then rank
    all rows. Every step is a narrow pass that counts rows per bucket.
    """
    group = F.col(by) if by else F.lit(0)
    names = [f"_b{i}" for i in range(len(buckets))]
    keyed = df.select(group.alias("_group"), *[b.alias(n) for b, n in zip(buckets, names)], *order)

    def counted(rows: DataFrame, depth: int) -> DataFrame:
        return rows.groupBy("_group", *names[: depth + 1]).agg(F.count(F.lit(1)).alias("_n"))

    counts = counted(keyed, 0).persist()
    try:
        totals = rows_if_small(
            counts.groupBy("_group").agg(F.sum("_n").alias("_n")), MAX_LITERAL_CUTS
        )
        if totals is None:
            return None
        sizes = {r["_group"]: r["_n"] for r in totals}
        wanted = targets(sizes)
        # Per cut: the bucket path so far, and the rank that is left within it.
        left = {(g, t): ((g,), t) for g, ts in wanted.items() for t in ts if t > 0}
        if len(left) > MAX_LITERAL_CUTS:
            return None
        rows: DataFrame = keyed
        for depth, name in enumerate(names):
            path = ["_group", *names[:depth]]
            if depth:
                rows = keyed.where(_any(_at(path, p) for p, _ in left.values()))
                counts_here = counted(rows, depth)
            else:
                counts_here = counts
            here = bucket_offsets(counts_here, path, name, "_n")
            holding = _any(
                _at(path, p) & (F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k)
                for p, k in left.values()
            )
            # One bucket holds each cut, so the result is no longer than the cut list.
            hits = here.where(holding).collect()
            left = {
                cut: (p + (r[name],), k - r["_before"])
                for cut, (p, k) in left.items() for r in hits
                if tuple(r[c] for c in path) == p and r["_before"] < k <= r["_before"] + r["_n"]
            }
        path = ["_group", *names]
        w = Window.partitionBy(*path).orderBy(*order)
        ranked = keyed.where(_any(_at(path, p) for p, _ in left.values())).withColumn(
            "_rn", F.row_number().over(w)
        )
        at_rank = ranked.where(_any(_at(path, p) & (F.col("_rn") == k) for p, k in left.values()))
        values = {
            (tuple(r[c] for c in path), r["_rn"]): tuple(r[o] for o in order)
            for r in at_rank.collect()
        }
        found = {cut: values[at] for cut, at in left.items()}
        return sizes, {g: [found.get((g, t)) for t in ts] for g, ts in wanted.items()}
    finally:
        counts.unpersist()


def _at(columns: Sequence[str], values: Sequence[Any]) -> Column:
    return reduce(
        Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, values)]
    )


def _any(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


# -- running values ---------------------------------------------------------

def fits_one_block(df: DataFrame, order: str, width: int) -> bool:
    """Whether every group is at most ``width`` long, measured by its largest step."""
    longest = df.agg(F.max(order)).first()[0]
    return longest is None or longest < width


def running_max(
    df: DataFrame, by: str, order: str, value: Column, name: str,
    inclusive: bool = True, width: int = 65_536, one_block: bool | None = None,
) -> DataFrame:
    """Running maximum of ``value`` along the step column ``order`` (0, 1, ..) within
    ``by``.

    Groups measured to be short take one window. Otherwise each block of ``width`` steps
    runs on its own and takes over the maximum of the earlier blocks, so no group is
    processed by a single task; the ``_block`` column stays for work on the same
    partitioning.
    """
    last = 0 if inclusive else -1
    if one_block is None:
        one_block = fits_one_block(df, order, width)
    if one_block:
        w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumn(name, F.max(value).over(w))
    keyed = df.withColumn("_block", F.floor(F.col(order) / F.lit(width))).withColumn("_value", value)
    tops = keyed.groupBy(by, "_block").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(by, "_block", F.max("_top").over(earlier).alias("_carry"))
    w = (
        Window.partitionBy(by, "_block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    return (
        keyed.withColumn("_inside", F.max("_value").over(w))
        .join(carry, [by, "_block"])
        .withColumn(name, F.greatest("_inside", "_carry"))
        .drop("_value", "_inside", "_carry")
    )
