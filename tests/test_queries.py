"""Every registered query against its SQL, and what the driver's contract asks for."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelwright.plans import all_queries
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert set(all_queries.QUERIES) == set(all_queries.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries.QUERIES) <= set(entry.queries())


@needs_tables
def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["indicator_key", "place_id", "kind"] and df.count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    line, ok = compare(spark, con, name, SF)
    assert ok, line
