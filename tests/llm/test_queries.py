"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare

OPS = sorted(n for n in entry.queries() if n.startswith("op"))


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in sorted(OPS, key=lambda n: int(n[2:].split("_")[0]))] == [
        *range(1, 14)]
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in OPS if n in entry.oracle_sql()])
def test_query(name, spark, con, tables):
    verdict = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], tables)
    assert verdict.startswith("ok"), verdict
