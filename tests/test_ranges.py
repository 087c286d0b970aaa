import csv
import random

import pytest

from checks import text_queries, views
from checks.registry import QUERIES
from textlab.sources import ranges
from textlab.sources.delimited import LABELLED_SCHEMA, read_labelled_csv

PIECES = ['"', '""', "\n", ",", "é😂", "plain words here ", "\t", " ", "\\", 'say "hi"', "\n\n\n", "x" * 700, '"\n']


@pytest.fixture
def narrow(spark):
    """Byte ranges of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rng, n, sep=",", ends="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=sep, lineterminator=ends)
        w.writerow(["row_id", "Tweet text", "Label"])
        rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))), rng.choice([0, 1, None]))
                for i in range(n)]
        w.writerows([("" if x is None else x for x in r) for r in rows])
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], str(r)))


@pytest.mark.parametrize("seed", range(6))
def test_as_the_whole_file_reader(spark, narrow, tmp_path, seed):
    rng = random.Random(seed)
    path = str(tmp_path / "a.csv")
    rows = write(path, rng, [0, 1, 80][seed % 3])
    got = rows_of(ranges.read_split_csv(spark, path))
    assert got == rows_of(read_labelled_csv(spark, path)) == sorted(rows, key=lambda r: (r[0], str(r)))
    if rows[2:]:
        assert ranges._lines(spark, [path]).rdd.getNumPartitions() > 20


def test_many_ranges_inside_quotes(spark, narrow, tmp_path):
    """More of them than are shipped: each range gets its own row by a join."""
    path = str(tmp_path / "a.csv")
    write(path, random.Random(9), 60)
    one = sorted(map(str, ranges.records(spark, [path]).collect()))
    assert sorted(map(str, ranges.records(spark, [path], few=1).collect())) == one


def test_a_record_over_many_ranges(spark, narrow, tmp_path):
    path = tmp_path / "a.csv"
    long = "line\n" * 2000
    path.write_text(f'row_id,Tweet text,Label\n1,"{long}",0\n2,"b ""q"" b",1\n3,"{long}x",1\n')
    assert rows_of(ranges.read_split_csv(spark, str(path))) == [(1, long, 0), (2, 'b "q" b', 1), (3, long + "x", 1)]


def test_several_files_tabs_and_line_ends(spark, narrow, tmp_path):
    rows = []
    for name, ends in (("a", "\n"), ("b", "\r\n")):
        rows += write(tmp_path / f"{name}.csv", random.Random(name), 30, "\t", ends)
    got = rows_of(ranges.read_split_csv(spark, str(tmp_path), sep="\t"))
    assert got == sorted(rows, key=lambda r: (r[0], str(r)))


def test_headers_and_broken_records(spark, tmp_path):
    def read(text):
        (tmp_path / "a.csv").write_text(text)
        return rows_of(ranges.read_split_csv(spark, str(tmp_path / "a.csv")))

    assert read("") == read("row_id,Tweet text,Label") == read('﻿"row_id","Tweet text",Label\n\n') == []
    assert read("row_id,Tweet text,Label\n1,x,0") == [(1, "x", 0)]
    for bad in ("row_id,Label,Tweet text\n1,0,x\n", "row_id,Tweet text,Label\n1,x,no\n"):
        with pytest.raises(Exception):
            read(bad)


def test_only_ranges_are_shuffled(spark, tmp_path):
    write(tmp_path / "a.csv", random.Random(1), 5)
    plan = ranges.read_split_csv(spark, str(tmp_path / "a.csv"), LABELLED_SCHEMA)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_the_query_writes_as_it_reads(spark, narrow, tmp_path, monkeypatch):
    """No task of the query gets all files of the table."""
    docs = [(i, f'text {i}, "x"', "en", "web", 9) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    paths = []
    monkeypatch.setattr(text_queries, "read_split", lambda s, p, *a: paths.append(p) or ranges.read_split_csv(s, p, *a))
    got = rows_of(QUERIES["read_split_csv"](spark, str(tmp_path)))
    want = rows_of(views.tweets(spark, str(tmp_path)))
    assert got == [(i, f'"{t}\n",\n', q) for i, t, q in want]
    assert spark.read.text(paths[0]).select("_metadata.file_path").distinct().count() >= 4
