import csv
import json
import os

import pytest
from pyspark.sql import types as T

from textlab.operators.labelled import labelled
from textlab.sources import delimited as D
from textlab.sources import sinks
from textlab.sources.storage import fresh_path, materialize, shared_dir, store_with_row_id
from textlab.streaming.clean import clean_stream, read_text_stream

TRICKY = ['he said "hi", ok', "two\nlines", 'back\\"slash', "tab\there", '"', "  spaced  ", "é 😂", "#a,b"]
SCHEMA = D.LABELLED_SCHEMA


def write(path, rows, sep):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=sep)
        w.writerow(["row_id", "Tweet text", "Label"])
        w.writerows(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def rows():
    return [(i, t, i % 2) for i, t in enumerate(TRICKY)]


def test_reads_what_csv_writers_write(spark, tmp_path, rows):
    write(tmp_path / "a.csv", rows, ",")
    assert rows_of(D.read_labelled_csv(spark, str(tmp_path / "a.csv"))) == rows


def test_round_trip_and_conversion(spark, tmp_path, rows):
    write(tmp_path / "a.txt", rows, "\t")
    path = D.convert_delimited(spark, str(tmp_path / "a.txt"), str(tmp_path / "out.csv"))
    assert rows_of(D.read_labelled_csv(spark, path)) == rows
    assert os.path.exists(tmp_path / "a.txt")
    assert D.convert_delimited(spark, path) == path


def test_malformed_number_fails(spark, tmp_path):
    write(tmp_path / "a.csv", [(1, "x", "no-number")], ",")
    with pytest.raises(Exception):
        D.read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()


def test_wrong_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("row_id,Label,Tweet text\n1,0,x\n")
    with pytest.raises(Exception):
        D.read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()


def test_files_without_a_key(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Tweet text,Label\nx,0\ny,1\n")
    raw = D.read_labelled_csv(spark, str(tmp_path / "a.csv"), T.StructType(SCHEMA.fields[1:]))
    df = labelled(store_with_row_id(raw, "keyed"))
    assert df.select("row_id").distinct().count() == 2
    assert rows_of(df) == rows_of(df)


def test_read_many(spark, tmp_path, rows):
    for n in ("a", "b"):
        write(tmp_path / f"{n}.csv", rows, ",")
    paths = [str(tmp_path / f"{n}.csv") for n in ("a", "b")]
    assert rows_of(D.read_many(spark, paths)) == sorted(rows * 2)
    assert rows_of(D.read_many(spark, paths[0])) == rows
    with pytest.raises(TypeError):
        D.read_many(spark, 7)
    with open(tmp_path / "c.csv", "w") as f:
        f.write("row_id,Tweet text\n9,x\n")
    short = T.StructType(SCHEMA.fields[:2])
    both = D.read_many(spark, [paths[0], str(tmp_path / "c.csv")], schemas={str(tmp_path / "c.csv"): short})
    assert (9, "x", None) in [tuple(r) for r in both.collect()]


def test_clean_directory(spark, tmp_path):
    write(tmp_path / "a.txt", [(1, " #the @bob ", 0)], "\t")
    write(tmp_path / "b.csv", [(2, "http://x y", 1)], ",")
    got = D.clean_directory(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r["file"]), r["Tweet text"], r["Label"]) for r in got) == [
        ("a.txt", "<HASHTAG> <USER>", 0), ("b.csv", "<URL> y", 1)]
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.csv"]


def test_labelled_types(spark, tmp_path, rows):
    write(tmp_path / "a.csv", rows, ",")
    df = labelled(D.read_labelled_csv(spark, str(tmp_path / "a.csv")))
    assert df.dtypes == [("row_id", "bigint"), ("text", "string"), ("label", "int")]


def test_ranked_trials_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "trial string, f1 double")
    out = sinks.write_ranked_trials(df, str(tmp_path / "t"), k=2)
    back = spark.read.csv(out, header=True).collect()
    assert [(r["trial"], r["f1"]) for r in back] == [("b", "0.9"), ("c", "0.5")]
    row = spark.createDataFrame([(0.75, 0.72)], "test_accuracy double, test_f1 double")
    path = sinks.write_summary(row, str(tmp_path / "s"), {"REDUX": None, "H_DIM": 8, "test_f1": -1})
    part = next(p for p in os.listdir(path) if p.endswith(".json"))
    with open(f"{path}/{part}") as f:
        assert json.loads(f.read()) == {"REDUX": None, "H_DIM": 8, "test_accuracy": 0.75, "test_f1": 0.72}


def test_fold_table_prunes_partitions(spark, tmp_path):
    df = spark.range(20).selectExpr("id as row_id", "cast(id % 4 as int) as fold")
    path = sinks.save_run(str(tmp_path / "run"), folds=df, split_by="fold")
    one = spark.read.parquet(f"{path}/folds").where("fold = 2")
    assert one.count() == 5
    assert "PartitionFilters: [isnotnull(fold" in one._jdf.queryExecution().executedPlan().toString()


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(5).toDF("x"), "m")
    assert df.inputFiles()[0].startswith(f"file://{shared_dir(spark)}/textlab/m-")
    assert df.count() == 5
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def test_stream_restart_repeats_nothing(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        stream = read_text_stream(spark, sf, schema, "documents.parquet", max_files=1)
        clean_stream(stream.select("doc_id", "text"), out, state).awaitTermination()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert spark.read.parquet(out).count() == n
