import os
import uuid

import pytest


@pytest.fixture
def parquet_dir(tmp_path_factory):
    """A new folder for tables written by a test."""
    return str(tmp_path_factory.mktemp(f"tables-{uuid.uuid4().hex[:6]}"))


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, source]) rows, with the usual columns."""
    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 AS fp", "'x' AS component_id", "2 AS n_words") if extra else df
    return make


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
