"""Every query with SQL gives the same rows as DuckDB; the others give rows with a stable schema."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, connect, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
CORE = {n: q for n, q in entry.queries().items() if not q.__module__.startswith("tessera.llm")}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    columns, rows = rows_of(CORE[name](spark, DATA))
    if name in ORACLES:
        assert rows == rows_of_sql(con, ORACLES[name], columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())
