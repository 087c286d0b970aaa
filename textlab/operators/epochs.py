"""Epochs without a sort: a keyed permutation of stored ranks.

Rows get a rank once and are stored with it. In every later epoch a row's place follows from
its rank by a permutation of 0 .. n - 1 that the seed and the epoch choose, computed for
each row on its own, so a batch is a filter and nothing is exchanged.

The permutation is a swap-or-not shuffle. Each round pairs every number x with k - x modulo
n and swaps the pair or not by a bit of the greater one: a bijection for any n, and the
rounds in reverse undo it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.keys import key_bucket, shuffle_key
from textlab.operators.ranks import bucketed_rank
from textlab.sources.storage import materialize

# Fixed value: a prime below 2**31, so products of two remainders fit a long.
_PRIME = 2_147_483_647
# A batch of at most so many rows is looked up by its ranks.
LISTED = 10_000


@dataclass(frozen=True)
class Ranked:
    """A stored table with ``rank`` from 0 on, and its number of rows."""

    rows: DataFrame
    n: int
    seed: int


def store_ranks(df: DataFrame, seed: int = 42, row_id: str = "row_id", path: str | None = None) -> Ranked:
    """Rank rows by a seeded digest of their id (ties by id) and store them in files that lie
    in the order of ranks, so a filter on ranks skips most of them."""
    keyed = df.withColumn("_key", shuffle_key(seed, row_id))
    ranked = bucketed_rank(keyed, key_bucket(F.col("_key")), [F.col("_key"), F.col(row_id)], name="rank")
    ranked = ranked.withColumn("rank", F.col("rank") - 1).drop("_key")
    stored = materialize(ranked.repartitionByRange("rank").sortWithinPartitions("rank"), "ranked", path)
    return Ranked(stored, stored.count(), seed)


def _rounds(n: int, seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """Per round the sum of a pair, and factor and offset of the deciding bit."""
    rng = np.random.default_rng([seed, epoch])
    count = 2 * max(n, 2).bit_length() + 8
    return [(int(rng.integers(n)), int(rng.integers(1, _PRIME)), int(rng.integers(_PRIME))) for _ in range(count)]


def place_of(rank: Column, n: int, seed: int, epoch: int) -> Column:
    """Place of a rank in an epoch, a column of 0 .. n - 1."""
    if n < 2:
        return rank
    keys = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(a).cast("bigint").alias("a"),
                              F.lit(c).cast("bigint").alias("c")) for k, a, c in _rounds(n, seed, epoch)])

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - x, F.lit(n).cast("bigint"))
        mixed = (F.greatest(x, other) % _PRIME * r["a"] + r["c"]) % _PRIME
        return F.when(F.shiftright(mixed, 15).bitwiseAND(F.lit(1).cast("bigint")) == 1, other).otherwise(x)

    return F.aggregate(keys, rank.cast("bigint"), step)


def ranks_at(places: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Ranks that stand at these places of an epoch: the rounds in reverse."""
    x = places.astype(np.int64)
    if n < 2:
        return x
    for k, a, c in reversed(_rounds(n, seed, epoch)):
        other = (k - x) % n
        mixed = (np.maximum(x, other) % _PRIME * a + c) % _PRIME
        x = np.where(mixed >> 15 & 1, other, x)
    return x


def epoch_batches(ranked: Ranked, batch_size: int, epoch: int = 0) -> DataFrame:
    """Rows with ``batch_id``: groups of ``batch_size`` in the order of an epoch."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    place = place_of(F.col("rank"), ranked.n, ranked.seed, epoch)
    return ranked.rows.withColumn("batch_id", F.floor(place / batch_size))


def epoch_batch(ranked: Ranked, batch_size: int, batch: int, epoch: int = 0) -> DataFrame:
    """The rows of one batch. The ranks of a small one are computed and looked up; those of
    a larger one are found by a filter on every row."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    first, end = batch * batch_size, min((batch + 1) * batch_size, ranked.n)
    if end - first > LISTED:
        place = place_of(F.col("rank"), ranked.n, ranked.seed, epoch)
        return ranked.rows.where((place >= first) & (place < end))
    ranks = ranks_at(np.arange(first, max(first, end)), ranked.n, ranked.seed, epoch)
    return ranked.rows.where(F.col("rank").isin(ranks.tolist()))
