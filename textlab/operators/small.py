"""Side tables whose size is checked before they are shipped to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 10_000


def rows_if_small(df: DataFrame, limit: int = MAX_SMALL_ROWS) -> list[Row] | None:
    """The rows of ``df`` when there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def localized(df: DataFrame, limit: int = MAX_SMALL_ROWS) -> DataFrame | None:
    """A driver-side copy of a small table, computed once; None when it is not small.
    Travelling as Arrow it comes back as a local relation of known size."""
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    return df.sparkSession.createDataFrame(table, df.schema)


def lookup_join(
    df: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner",
    limit: int = MAX_SMALL_ROWS,
) -> DataFrame:
    """Equi-join with a side table: broadcast when measured small, else shuffled, where
    adaptive execution splits skewed keys."""
    local = localized(table, limit)
    return df.join(table, on, how) if local is None else df.join(F.broadcast(local), on, how)
