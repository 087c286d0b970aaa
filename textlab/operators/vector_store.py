"""Vectors kept by content: every distinct text is encoded once, however often it occurs.

The store is a folder of Parquet tables ``encoder=<name>/slice=<n>`` of ``digest, vector``;
the digest is the SHA-256 of the text. What is new is found by an anti-join on digests
alone. New texts are encoded slice by slice, each slice one write that is there as a whole
or not at all, so what a failed run has finished is not encoded again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.embed import EncoderFactory, embed
from textlab.sources.storage import fresh_path

SLICES = 16
_STORED = "digest binary, vector array<float>"


def text_digest(text: Column | str) -> Column:
    """SHA-256 of a text as 32 bytes, null for null."""
    return F.unhex(F.sha2(F.col(text) if isinstance(text, str) else text, 256))


def _folder(store: str, name: str) -> str:
    if not name or "/" in name or "=" in name:
        raise ValueError("an encoder's name must not be empty or hold / or =")
    return f"{store.rstrip('/')}/encoder={name}"


def stored_vectors(spark: SparkSession, store: str, name: str) -> DataFrame:
    """``digest, vector`` of all texts that an encoder has met, each once."""
    try:
        found = spark.read.schema(_STORED).parquet(_folder(store, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], _STORED)
    return found.select("digest", "vector").dropDuplicates(["digest"])


def missing_texts(df: DataFrame, store: str, name: str, text: str = "text") -> DataFrame:
    """``digest, text`` of the distinct texts of a table that are not stored yet."""
    keyed = df.where(F.col(text).isNotNull()).select(text_digest(text).alias("digest"), F.col(text).alias("text"))
    known = stored_vectors(df.sparkSession, store, name).select("digest")
    # Digests alone decide what is new; copies meet before their texts are shuffled.
    new = keyed.select("digest").distinct().join(known, "digest", "left_anti")
    return keyed.join(new, "digest", "left_semi").groupBy("digest").agg(F.any_value("text").alias("text"))


def update_store(
    df: DataFrame, store: str, name: str, encoder: str | EncoderFactory = "hashing", text: str = "text",
    batch_size: int = 32, width: int = 64, slices: int = SLICES,
) -> int:
    """Encode the texts of a table that the store does not have; returns how many there were.

    ``name`` stands for the encoder and all that its vectors depend on. One writer per
    name at a time.
    """
    spark = df.sparkSession
    folder = _folder(store, name)
    todo = fresh_path(spark, "new-texts")
    place = F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int")
    missing_texts(df, store, name, text).withColumn("slice", place).write.partitionBy("slice").parquet(todo)
    waiting = spark.read.schema("digest binary, text string, slice int").parquet(todo)
    counts = waiting.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).orderBy("slice").collect()  # one a slice
    for r in counts:
        part = waiting.where(F.col("slice") == r["slice"]).select("digest", "text")
        done = embed(part, encoder, "text", batch_size, width, "vector")
        done.select("digest", F.col("vector").cast("array<float>").alias("vector")).write.mode(
            "append").parquet(f"{folder}/slice={r['slice']}")
    return sum(r["n"] for r in counts)


def embed_stored(
    df: DataFrame, store: str, name: str, encoder: str | EncoderFactory = "hashing", text: str = "text",
    batch_size: int = 32, width: int = 64, out: str = "embedding", slices: int = SLICES,
) -> DataFrame:
    """`embed` by way of the store: what it lacks is encoded and stored first. A null text
    has a null vector; every input row gives one output row."""
    update_store(df, store, name, encoder, text, batch_size, width, slices)
    vectors = stored_vectors(df.sparkSession, store, name).select(
        F.col("digest").alias("_digest"), F.col("vector").alias(out))
    rows = df.drop(out).withColumn("_digest", text_digest(text))
    return rows.join(vectors, "_digest", "left").drop("_digest")
