"""Delimited text files: read, convert, sweep a folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.operators.labelled import clean
from textlab.sources.storage import fresh_path

# The columns of the labelled text files.
LABELLED_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("Tweet text", T.StringType()),
    T.StructField("Label", T.IntegerType()),
])

# Quotes are doubled inside quoted fields, and a field may hold line breaks.
READ_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "mode": "FAILFAST", "enforceSchema": False,
}
WRITE_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_labelled_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = LABELLED_SCHEMA,
    sep: str = ",",
    quote: str = '"',
) -> DataFrame:
    """CSV with header under a fixed schema; a malformed record or a header that names
    other columns fails the read. Files without a key: leave ``row_id`` out of the schema
    and store the table with `store_with_row_id`.

    Quoted line breaks make a file unsplittable, so land large inputs as many files, or
    once as parquet.
    """
    paths = [path] if isinstance(path, str) else list(path)
    options = READ_OPTIONS | {"sep": sep, "quote": quote}
    return spark.read.schema(schema).options(**options).csv(paths)


def read_many(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = LABELLED_SCHEMA,
    schemas: Mapping[str, T.StructType] | None = None,
) -> DataFrame:
    """One or several files as one table, duplicates kept.

    ``schemas`` gives files of their own columns; those are united by name, with nulls
    where a column is missing. Files of one schema are a single scan.
    """
    if isinstance(paths, str):
        paths = [paths]
    elif not isinstance(paths, (list, tuple)):
        raise TypeError("paths must be a string or a list of strings")
    if not paths:
        raise ValueError("no path given")
    own = schemas or {}
    common = [p for p in paths if p not in own]
    parts = [read_labelled_csv(spark, common, schema)] if common else []
    parts += [read_labelled_csv(spark, p, own[p]) for p in paths if p in own]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """CSV with header, quoted so that `read_labelled_csv` gives the same strings."""
    df.write.options(**WRITE_OPTIONS, sep=sep).csv(path)
    return path


def convert_delimited(
    spark: SparkSession,
    source: str,
    target: str | None = None,
    schema: T.StructType = LABELLED_SCHEMA,
    quote: str = '"',
) -> str:
    """Tab-separated to comma-separated; returns the new path. A source that is CSV
    already is returned as it is. The source is never deleted."""
    if source.rstrip("/").endswith("csv"):
        return source
    target = target or fresh_path(spark, "converted") + ".csv"
    return write_csv(read_labelled_csv(spark, source, schema, sep="\t", quote=quote), target)


def clean_directory(
    spark: SparkSession,
    path: str,
    schema: T.StructType = LABELLED_SCHEMA,
    text: str = "Tweet text",
    names: Mapping[str, str] | None = None,
    quote: str = '"',
) -> DataFrame:
    """Read every ``.txt`` (tabs) and ``.csv`` file below a folder, clean the text and
    add ``file``, the source path. One scan per format, no conversion on disk."""
    def scan(glob: str, sep: str) -> DataFrame:
        options = READ_OPTIONS | {"sep": sep, "quote": quote}
        reader = spark.read.schema(schema).options(
            **options, recursiveFileLookup=True, pathGlobFilter=glob
        )
        return reader.csv(path).withColumn("file", _file())

    both = scan("*.txt", "\t").unionByName(scan("*.csv", ","))
    return clean(both, text, names)


def _file() -> Column:
    return F.col("_metadata.file_path")
