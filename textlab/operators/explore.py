"""Label and hashtag counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.operators.small import lookup_join, rows_if_small


def top(df: DataFrame, count: str, tie: str, k: int | None = None) -> DataFrame:
    """Largest counts first, ties by name; with ``k`` only the first k."""
    ordered = df.orderBy(F.desc(count), F.asc(tie))
    return ordered if k is None else ordered.limit(k)


def count_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, most frequent first; missing labels are not counted."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("count")
    )
    return top(counts, "count", label)


def exploded_hashtags(col: str = "text") -> Column:
    """One row per hashtag, and a null for text without any. Unlike a plain ``explode``,
    this does not make Spark test the array, and run the regex, once more beforehand."""
    return F.explode_outer(T.hashtags(col)).alias("hashtag")


def count_hashtags(df: DataFrame, col: str = "text", k: int | None = None) -> DataFrame:
    """Occurrences of every hashtag in raw text, case-sensitive.

    A hashtag in a third of the rows costs nothing extra: counts are combined before
    the shuffle.
    """
    tags = df.where(F.col(col).contains("#")).select(exploded_hashtags(col))
    tags = tags.where(F.col("hashtag").isNotNull())
    return top(tags.groupBy("hashtag").agg(F.count(F.lit(1)).alias("count")), "count", "hashtag", k)


# Entries of a dictionary that are brought to the driver.
MAX_NAMES = 1_000_000


def emoji_tokens(
    df: DataFrame, names: DataFrame, pattern: str, col: str = "text", row_id: str = "row_id"
) -> DataFrame:
    """Every emoji of the text with its name from a table ``emoji, name``:
    ``row_id, pos, emoji, name``. Emoji without a name keep a null name."""
    found = F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(0))
    tokens = df.select(row_id, F.posexplode(found).alias("pos", "emoji"))
    return lookup_join(tokens, names.select("emoji", "name"), "emoji", how="left").select(
        row_id, "pos", "emoji", "name"
    )


def names_of(table: DataFrame) -> dict[str, str]:
    """A stored dictionary ``emoji, name`` for the text functions; it travels by the driver,
    so its size is checked."""
    rows = rows_if_small(table.select("emoji", "name"), MAX_NAMES)
    if rows is None:
        raise ValueError("the dictionary is too large for the driver; use emoji_tokens")
    return {r["emoji"]: r["name"] for r in rows}
