"""Exact, seeded splits and folds on a stored ``row_id``.

The order is the digest of ``seed:row_id``, so it does not depend on the layout of the
data. Splits and folds are ranges of that order: after two narrow passes that locate
the cut rows, assigning a row is a comparison with literals and moves no data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.keys import key_bucket, shuffle_key
from textlab.operators.ranks import beyond, bucketed_rank, find_cuts
from textlab.operators.small import lookup_join

TRAIN, VALIDATION = "train", "val"


def _keyed(df: DataFrame, seed: int, row_id: str) -> DataFrame:
    return df.withColumn("_key", shuffle_key(seed, row_id))


def _order(row_id: str) -> list[str]:
    return ["_key", row_id]


def _passed(row_id: str, cuts: list[tuple | None]) -> Column:
    """Number of cuts a row lies beyond."""
    flags = [
        F.lit(1) if cut is None else beyond(_order(row_id), cut).cast("int") for cut in cuts
    ]
    return reduce(Column.__add__, flags, F.lit(0))


def exact_split(
    df: DataFrame, fraction: float = 0.8, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """Adds ``split``: exactly ``int(fraction * n)`` random rows are ``train``."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    keyed = _keyed(df, seed, row_id)
    _, cuts = find_cuts(
        keyed, [key_bucket(F.col("_key"))], _order(row_id),
        lambda sizes: {g: [int(fraction * n)] for g, n in sizes.items()},
    )
    side = F.when(_passed(row_id, cuts.get(0, [])) == 0, TRAIN).otherwise(VALIDATION)
    return keyed.withColumn("split", side).drop("_key")


def _even_cuts(n: int, k: int) -> list[int]:
    sizes = [n // k + (i < n % k) for i in range(k)]
    return [sum(sizes[: i + 1]) for i in range(k - 1)]


def kfold(df: DataFrame, k: int = 5, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Adds ``fold`` in [0, k): shuffled folds, sizes differ by at most one, larger first."""
    _check_k(k)
    keyed = _keyed(df, seed, row_id)
    cuts = find_cuts(
        keyed, [key_bucket(F.col("_key"))], _order(row_id),
        lambda sizes: {g: _even_cuts(n, k) for g, n in sizes.items()},
    )
    if cuts is None:  # more folds than literals
        ranked = bucketed_rank(keyed, key_bucket(F.col("_key")), _order(row_id), name="_rank")
        fold = _ntile(F.col("_rank"), df.count(), k)
        return ranked.withColumn("fold", fold).drop("_key", "_rank")
    fold = _passed(row_id, cuts[1].get(0, []))
    return keyed.withColumn("fold", fold).drop("_key")


def _ntile(rank: Column, n: int, k: int) -> Column:
    big, small = n % k, n // k
    head = big * (small + 1)
    late = F.floor((rank - 1 - head) / F.lit(max(small, 1))) + big
    return F.when(rank <= head, F.floor((rank - 1) / F.lit(small + 1))).otherwise(late).cast("int")


def _stride_cuts(offset: int, n: int, k: int) -> list[int]:
    """Ends of the first k-1 folds of a class that owns the places ``offset ..
    offset+n-1`` of a deal to folds in turn."""
    ends, total = [], 0
    for i in range(k - 1):
        total += (offset + n - 1 - i) // k - (offset - 1 - i) // k
        ends.append(total)
    return ends


def stratified_kfold(
    df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """Adds ``fold`` in [0, k): per class, fold sizes differ by at most one, and the
    places left over are dealt to the folds in turn across classes."""
    _check_k(k)
    keyed = _keyed(df, seed, row_id)

    def targets(sizes: dict) -> dict:
        out, offset = {}, 0
        for g in sorted(sizes, key=lambda v: (v is not None, v)):
            out[g] = _stride_cuts(offset, sizes[g], k)
            offset += sizes[g]
        return out

    cuts = find_cuts(keyed, [key_bucket(F.col("_key"))], _order(row_id), targets, by=label)
    if cuts is None:
        return _stratified_by_rank(keyed, k, label, row_id).drop("_key")
    fold = F.lit(None).cast("int")
    for g, cs in cuts[1].items():
        fold = F.when(F.col(label).eqNullSafe(F.lit(g)), _passed(row_id, cs)).otherwise(fold)
    return keyed.withColumn("fold", fold).drop("_key")


def _stratified_by_rank(keyed: DataFrame, k: int, label: str, row_id: str) -> DataFrame:
    """The same folds for any number of classes: rank every row within its class."""
    ranked = bucketed_rank(
        keyed, key_bucket(F.col("_key")), _order(row_id), by=[label], name="_rank"
    )
    classes = keyed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.col(label).asc_nulls_first())  # one row per class
    classes = classes.withColumn("_off", F.sum("_n").over(before) - F.col("_n"))
    size = lambda i: (
        F.floor((F.col("_off") + F.col("_n") - 1 - i) / F.lit(k))
        - F.floor((F.col("_off") - 1 - i) / F.lit(k))
    )
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("bigint"),
                              lambda acc, j: acc + size(j)),
    )
    classes = classes.select(
        F.struct(label).alias("_class"), F.slice(ends, 1, k - 1).alias("_ends")
    )
    tagged = ranked.withColumn("_class", F.struct(label))
    return (
        lookup_join(tagged, classes, "_class")
        .withColumn("fold", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
        .drop("_class", "_ends", "_rank")
    )


def _check_k(k: int) -> None:
    if k < 2:
        raise ValueError("k must be at least 2")


def take_fold(df: DataFrame, fold: int, side: str = VALIDATION) -> DataFrame:
    """Validation rows of a fold, or its complement as training rows."""
    if side not in (TRAIN, VALIDATION):
        raise ValueError(f"side must be {TRAIN!r} or {VALIDATION!r}")
    here = F.col("fold") == fold
    return df.where(here if side == VALIDATION else ~here)


def take_split(df: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows whose key is in an external id table."""
    return df.join(ids.select(row_id), row_id, "left_semi")


def fold_distribution(df: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """Label counts of every fold, validation and training side, zeros included."""
    cells = df.groupBy(label, "fold").agg(F.count(F.lit(1)).alias("n"))
    per_label = cells.groupBy(label).agg(
        F.sum("n").alias("_all"),
        F.collect_list(F.struct("fold", "n")).alias("_cells"),  # at most k entries
    )
    folds = per_label.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    n_val = F.aggregate(
        "_cells", F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.when(c["fold"] == F.col("fold"), c["n"]).otherwise(0),
    )
    return folds.withColumn("n_val", n_val).select(
        "fold", label, (F.col("_all") - F.col("n_val")).alias("n_train"), "n_val"
    )


def shuffled(
    df: DataFrame, seed: int = 42, epoch: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """Seeded total order, new for every epoch (a range-partitioned sort)."""
    key = shuffle_key(f"{seed}:{epoch}", row_id)
    return df.withColumn("_key", key).orderBy("_key", row_id).drop("_key")


def assign_batches(
    df: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """Adds ``batch_id``: consecutive groups of ``batch_size`` rows of the shuffled order."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    keyed = df.withColumn("_key", shuffle_key(f"{seed}:{epoch}", row_id))
    ranked = bucketed_rank(keyed, key_bucket(F.col("_key")), _order(row_id), name="_rank")
    batch = F.floor((F.col("_rank") - 1) / F.lit(batch_size))
    return ranked.withColumn("batch_id", batch).drop("_key", "_rank")
