"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import compare

SLOW = {"cross_validate", "search", "run_experiment", "evaluate_file", "run_session_mlp"}
OPTIONAL = re.compile(r"op\d+_|pipeline$")  # tested beside the part that registers them
NAMES = [n for n in entry.queries() if n not in SLOW and not OPTIONAL.match(n)]


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, con, sf):
    verdict = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert verdict.startswith(("ok", "rows only")), verdict
    assert "TYPES" not in verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
