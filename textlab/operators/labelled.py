"""The labelled text table: projection, casts, cleaning, record merge, preview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import text as T


def labelled(
    df: DataFrame, text: str = "Tweet text", label: str = "Label", row_id: str = "row_id"
) -> DataFrame:
    """``row_id, text, label``: the only columns later steps read."""
    return df.select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.col(text).alias("text"),
        F.col(label).cast("int").alias("label"),
    )


def rename_positional(df: DataFrame, names: Sequence[str] = ("Tweet", "Label")) -> DataFrame:
    """Rename columns by position."""
    return df.toDF(*names)


def cast_label(label: Column | str, multiclass: bool) -> Column:
    """Class ids as BIGINT for several classes, DOUBLE targets for two."""
    c = F.col(label) if isinstance(label, str) else label
    return c.cast("bigint" if multiclass else "double")


def clean(
    df: DataFrame,
    col: str = "text",
    names: Mapping[str, str] | None = None,
    stop: Sequence[str] = T.STOP_HASHTAGS,
    mode: str = "all",
) -> DataFrame:
    """Clean one text column in place, in batch and streaming tables alike."""
    return df.withColumn(col, T.clean_text(col, names, stop, mode))


def merge_record(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Add or overwrite constant columns; later values win, whole numbers are narrowed
    to INT when they fit."""
    def constant(v: Any) -> Column:
        if v is None:
            return F.lit(None).cast("string")
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("int" if abs(v) < 2**31 else "bigint")
        return F.lit(v)

    return df.withColumns({k: constant(v) for k, v in values.items()})


def preview(df: DataFrame, n: int = 5, row_id: str = "row_id") -> DataFrame:
    """First rows by key."""
    return df.orderBy(row_id).limit(n)
