"""Text to vectors, and vectors per token to one vector per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textlab.functions.binding import let

# Letters, digits and underscore; the encoder's own notion of a word.
TOKEN = r"[\p{L}\p{N}_]+"

# An encoder factory returns a function from a list of texts to one vector per text.
Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
EncoderFactory = Callable[[], Encoder]


def hashing_vector(col: Column | str, width: int = 64) -> Column:
    """Counts of lower-cased words by hashed slot, scaled to unit length.

    The slot is taken from the first 32 bits of the word's digest. One pass per text, no
    shuffle; text without words gives a zero vector.
    """
    c = F.col(col) if isinstance(col, str) else col
    words = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    slots = F.transform(F.transform(words, F.md5), lambda h: _slot(h, width))
    vector = let(_slot_counts(slots, width), _unit_length)
    return F.when(c.isNotNull(), vector)


def _slot(digest: Column, width: int) -> Column:
    """The first eight hexadecimal digits modulo ``width``; digits that cannot change it are
    left out."""
    # A digit's place in this string is its value, and 0 is not found.
    digit = lambda p: F.instr(F.lit("123456789abcdef"), F.substring(digest, 8 - p, 1))
    values = [digit(p) * F.lit(16**p % width).cast("bigint") for p in range(8) if 16**p % width]
    return (sum(values, F.lit(0)) % width).cast("int")


def _slot_counts(slots: Column, width: int) -> Column:
    """How often each slot occurs. With every slot added once the runs of the sorted array
    are the slots in order, so one pass finds all counts."""
    every = F.sequence(F.lit(0), F.lit(width - 1))

    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                        lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))

    def counts(s: Column) -> Column:
        return let(starts(s), lambda at: F.transform(
            at, lambda p, k: (F.coalesce(F.get(at, k + 1), F.size(s)) - p - 1).cast("double")))

    return let(F.sort_array(F.concat(slots, every)), counts)


def _unit_length(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    scaled = lambda n: F.transform(
        v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)).cast("float")
    )
    return let(norm, scaled)


def _encoder_udf(factory: EncoderFactory, batch_size: int):
    @pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()  # once per task, not per batch
        for texts in batches:
            values = texts.to_list()
            known = [i for i, t in enumerate(values) if t is not None]
            out: list = [None] * len(values)
            for start in range(0, len(known), batch_size):
                part = known[start:start + batch_size]
                vectors = encoder([values[i] for i in part])
                if len(vectors) != len(part):
                    raise ValueError("the encoder must return one vector per text")
                for i, v in zip(part, vectors):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return encode


def embed(
    df: DataFrame,
    encoder: str | EncoderFactory = "hashing",
    text: str = "text",
    batch_size: int = 32,
    width: int = 64,
    out: str = "embedding",
    partitions: int | None = None,
) -> DataFrame:
    """Adds a float vector per text.

    ``encoder`` is ``"hashing"`` or a factory that loads a model inside each task; only
    the text column crosses to Python. Embed once, store the result, and reuse it for
    every fold, trial and fit. ``partitions`` spreads the rows evenly first, for encoders
    that take far longer than moving their text.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if partitions is not None:
        df = df.repartition(partitions)
    if encoder == "hashing":
        return df.withColumn(out, hashing_vector(text, width))
    if not callable(encoder):
        raise ValueError(f"unknown encoder {encoder!r}: use 'hashing' or an encoder factory")
    return df.withColumn(out, _encoder_udf(encoder, batch_size)(F.col(text)))


def embedding_profile(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Row count and vector width in one row; fails when widths differ."""
    got = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(vector)).alias("_low"),
        F.max(F.size(vector)).alias("_high"),
    )
    width = F.when(
        F.col("_low") != F.col("_high"), F.raise_error(F.lit("vector widths differ"))
    ).otherwise(F.col("_low"))
    return got.select("n_rows", width.cast("int").alias("width"))


def pool_first(df: DataFrame, token: str = "token") -> DataFrame:
    """Vector of the first token of every document in long form: a filter, no grouping.
    For arrays of token vectors see ``functions.scoring.pool_first``."""
    return df.where(F.col(token) == 0)


def pool_mean(
    df: DataFrame,
    key: str = "doc_id",
    vector: str = "embedding",
    layer: str | None = None,
    last_layers: int = 4,
) -> DataFrame:
    """Mean vector per key over all tokens (of the last layers when a layer column is
    given). There are no padding rows in long form, so padding never counts.

    Vector sums are combined before the shuffle; a document of any length is reduced
    in pieces and nothing is exploded per dimension.
    """
    if layer is not None:
        top = df.agg(F.max(layer)).scalar()
        df = df.where(F.col(layer) > top - F.lit(last_layers))
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.groupBy(key).agg(vector_to_array(mean).alias(vector))
