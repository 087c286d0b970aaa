"""An incremental sweep over a folder of delimited files.

Every run takes the files that no run before it has finished, cleans their text and appends
the rows; files are remembered by the stream's checkpoint. A micro-batch writes to folders
that carry its number and replaces what a broken attempt left there, so a restart repeats
nothing. Records that do not fit the schema go to a table of their own instead of ending
the job, and a manifest counts both per file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textlab.operators.labelled import clean
from textlab.sources.delimited import LABELLED_SCHEMA, READ_OPTIONS

_BAD = "_bad_record"


def sweep_files(
    spark: SparkSession, folder: str, out: str, checkpoint: str, schema: T.StructType = LABELLED_SCHEMA,
    text: str = "Tweet text", names: Mapping[str, str] | None = None, sep: str = ",", files: str = "*.csv",
    max_files: int | None = None, recursive: bool = True,
) -> StreamingQuery:
    """Start a sweep that ends when the files present are done; ``awaitTermination`` waits.

    Below ``out``: ``rows`` (cleaned rows with ``file``), ``quarantine`` (``file, record``)
    and ``manifest`` (``file, rows, bad``), all with ``batch``, the number of the
    micro-batch. A file's header is not checked by name. ``max_files`` bounds a micro-batch.
    """
    options = READ_OPTIONS | {
        "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "pathGlobFilter": files,
        "enforceSchema": True, "recursiveFileLookup": recursive}
    if max_files is not None:
        options["maxFilesPerTrigger"] = max_files
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    stream = spark.readStream.schema(wide).options(**options).csv(folder).withColumn(
        "file", F.col("_metadata.file_path"))

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()  # read once for the three tables
        try:
            good = batch.where(F.col(_BAD).isNull()).drop(_BAD)
            parts = {
                "rows": clean(good, text, names),
                "quarantine": batch.where(F.col(_BAD).isNotNull()).select("file", F.col(_BAD).alias("record")),
                "manifest": batch.groupBy("file").agg(
                    F.count_if(F.col(_BAD).isNull()).alias("rows"), F.count_if(F.col(_BAD).isNotNull()).alias("bad")),
            }
            for name, part in parts.items():
                part.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def swept(spark: SparkSession, out: str, table: str = "rows") -> DataFrame:
    """A table of all sweeps into ``out``."""
    if table not in ("rows", "quarantine", "manifest"):
        raise ValueError("the tables are rows, quarantine and manifest")
    return spark.read.parquet(f"{out.rstrip('/')}/{table}")
