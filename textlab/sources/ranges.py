"""Quoted CSV files of any size, read by byte ranges.

A line break inside quotes does not end a record, so a reader that starts in the middle of
a file cannot know what a line means. But whether a place lies inside quotes is the parity
of the quotes before it. One narrow pass counts the quotes of every byte range, a running
sum over the ranges tells each of them how it begins, and then every task cuts the records
that begin in its ranges. What is left is the record that each range leaves open: its lines
and those at the start of the following ranges are put together by one small shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.operators.small import MAX_SMALL_ROWS, rows_if_small
from textlab.sources.delimited import LABELLED_SCHEMA

_CUT = "file string, start long, part long, first boolean, text string"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The lines of all files in order within their byte range (``file, start``). A line
    belongs to the range it begins in."""
    raw = spark.read.option("lineSep", "\n").text(list(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _ranges(lines: DataFrame, quote: str) -> DataFrame:
    """Per range ``inside`` (it begins inside quotes) and ``origin``: the start of the range
    in which the record that is open at its beginning began.

    Counts are combined before the shuffle; after it there is one row per range.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    odd = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"), F.max(quotes % 2).alias("turns"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = odd.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    # A range that begins inside quotes, with an even number of them on all of its lines, is
    # all the middle of a record.
    begins = ~F.col("inside") | (F.col("turns") > 0)
    return known.select("file", "start", "inside", F.max(F.when(begins, F.col("start"))).over(before).alias("origin"))


def _cut(inside: dict[tuple[str, int], int | None], quote: str):
    """Records of a partition's lines. ``inside`` has the ranges that begin inside quotes.

    Rows are ``file, start, part, first, text``: a whole record has part -1; the lines of a
    record that goes on in another range have the start of the range it began in and a
    number by which its parts are put in order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, is_open, first, head = None, [], False, False, False
        rows: list[tuple] = []

        def close() -> None:
            """End of a range: what is held goes on in the next one."""
            if held or head:
                file, start = here
                origin = inside[here] if head else start
                # The middle or end of a record that began before, or the beginning of one.
                rows.append((file, origin, start, first, "\n".join(held)))

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != here:
                    if here is not None:
                        close()
                    here, held = (file, start), []
                    is_open = head = here in inside
                    first = start == 0
                held.append(line)
                if line.count(quote) % 2:
                    is_open = not is_open
                if not is_open:
                    origin = inside[here] if head else start
                    rows.append((file, origin, start if head else -1, first and not head, "\n".join(held)))
                    held, first, head = [], False, False
            if len(rows) > 1000:
                yield _batch(rows)
                rows.clear()
        if here is not None:
            close()
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))
    ], names=["file", "start", "part", "first", "text"])


def records(spark: SparkSession, paths: Sequence[str], quote: str = '"', few: int = MAX_SMALL_ROWS) -> DataFrame:
    """``file, first, text``: every record of the files as one string, quoted line breaks
    included; ``first`` marks the first record of a file."""
    lines = _lines(spark, paths)
    starts = _ranges(lines, quote).where("inside").select("file", "start", "origin")
    small = rows_if_small(starts, few)
    if small is not None:
        inside = spark.sparkContext.broadcast({(r["file"], r["start"]): r["origin"] for r in small})
        cut = lines.mapInArrow(lambda batches: _cut(inside.value, quote)(batches), _CUT)
    else:
        # Too many to ship: each range gets its own row by a join, its lines in order again.
        numbered = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "start"], "left")
        dealt = numbered.repartition("file", "start").sortWithinPartitions("file", "start", "at")
        cut = dealt.select("file", "start", "line", "origin").mapInArrow(_cut_with_origin(quote), _CUT)
    whole = cut.where("part < 0").select("file", "first", "text")
    parts = F.array_sort(F.collect_list(F.struct("part", "first", "text")))
    joined = cut.where("part >= 0").groupBy("file", "start").agg(parts.alias("p")).select(
        "file", F.col("p")[0]["first"].alias("first"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined)


def _cut_with_origin(quote: str):
    """The same where every line brings the origin of its range, null outside of quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: dict = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inside.clear()  # of the ranges in this batch; `_cut` asks at a range's first line
                for file, start, origin in zip(*(batch[c].to_pylist() for c in ("file", "start", "origin"))):
                    if origin is not None:
                        inside[file, start] = origin
                yield batch.select(["file", "start", "line"])

        yield from _cut(inside, quote)(noted())

    return run


def read_split_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = LABELLED_SCHEMA,
    sep: str = ",",
    quote: str = '"',
) -> DataFrame:
    """The rows that `read_labelled_csv` gives, read by as many tasks as the files have
    byte ranges (``spark.sql.files.maxPartitionBytes``).

    Quotes are doubled inside quoted fields and fields may hold line breaks, which are kept
    as they stand (in files with CR LF line ends the other reader makes them LF); line ends
    are LF or CR LF. Every file has a header, and one that names other columns fails the read,
    as does a malformed record. A quote inside an unquoted field is not allowed, and an
    unclosed one runs to the end of the file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    text = F.regexp_replace(F.col("text"), F.lit("\r$"), F.lit(""))
    found = records(spark, paths, quote).select("first", text.alias("text"))
    header = F.when(F.col("first"), _is_header(schema, sep, quote)).otherwise(False)
    options = {"sep": sep, "quote": quote, "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    rows = found.where((F.col("text") != "") & ~header)
    return rows.select(F.from_csv("text", schema.toDDL(), options).alias("r")).select("r.*")


def _is_header(schema: T.StructType, sep: str, quote: str) -> Column:
    """True for a record with the names of the columns in order; another one fails."""
    def plain(name: Column) -> Column:
        return F.trim(F.replace(name, F.lit(quote), F.lit("")))

    names = F.transform(F.split(F.replace("text", F.lit("﻿"), F.lit("")), "\\Q" + sep + "\\E"), plain)
    want = F.array(*[F.lit(f.name) for f in schema.fields])
    return F.when(names == want, True).otherwise(
        F.raise_error(F.concat(F.lit("the header does not name the columns: "), F.substring("text", 1, 200))))
