"""Where intermediate tables go: the shared folder named by the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without the setting
    gets a temporary folder of its own; a cluster must name a shared one."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return f"{tempfile.gettempdir()}/textlab-{context.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/textlab/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table once and read it back: cuts the lineage and survives the loss of
    executors, unlike cached blocks."""
    target = path or fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file from the driver to any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def store_with_row_id(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Give rows without a key a ``row_id`` and store them with it. The id depends on the
    file layout, so it is drawn once and read back from then on."""
    keyed = df.select(F.monotonically_increasing_id().alias("row_id"), "*")
    return materialize(keyed, name, path)
