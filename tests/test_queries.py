"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from emberkey.plans.queries import QUERIES, SQL  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def ordered(names, rows):
    columns = sorted(names)
    at = [list(names).index(c) for c in columns]
    plain = [tuple(float(r[i]) if hasattr(r[i], "as_tuple") else r[i] for i in at) for r in rows]
    return columns, sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.sql(SQL[name])
    assert ordered(df.columns, df.collect()) == ordered(want.columns, want.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
