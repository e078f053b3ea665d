"""Every registered query runs, and equals its SQL where it has one."""

import os
import re

import pytest

import __spark_entry__ as contract
from check import kind, table
from fleetgauge.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
# The text queries have their own tests.
QUERIES = {n: q for n, q in contract.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
SQL = {n: s for n, s in contract.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    res = duck.execute(SQL[name])
    want = res.fetchall()
    a, b = table(df.columns, got), table([d[0] for d in res.description], want)
    assert a == b
    assert not got or [kind(v) for v in a[1][0]] == [kind(v) for v in b[1][0]]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
