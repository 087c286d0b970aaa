"""Clean a stream of text files with the batch expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textlab.operators.labelled import clean


def read_text_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def clean_stream(
    stream: DataFrame, out: str, checkpoint: str, col: str = "text",
    names: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Write the cleaned stream as parquet until the available input is consumed. The
    cleaning is stateless; the checkpoint makes a restarted job continue where it
    stopped, without loss or repetition."""
    cleaned = clean(stream, col, names)
    return (
        cleaned.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(out)
    )
