"""Every query with SQL gives the same rows as DuckDB on the driver tables."""

import os

import pytest

import __spark_entry__ as E
from tabrisk.plans.check import compare

from .conftest import SF_ORACLE, SF_SMALL

SQL_QUERIES = sorted(E.oracle_sql())


def test_every_query_registered_with_a_callable():
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert all(callable(f) for f in qs.values())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) >= {"split", "label", "n_rows"}


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_matches_duckdb(spark, name):
    sf = SF_SMALL if os.path.exists(SF_SMALL) else SF_ORACLE
    ok, msg = compare(E.queries()[name](spark, sf), E.oracle_sql()[name], sf)
    assert ok, msg
