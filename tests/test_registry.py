from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from casepulse.plans import checks, registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, CHECKS = registry.queries(), checks.oracle_sql()


@pytest.fixture(scope="module")
def db(testdata):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{testdata}/{name}.parquet'")
    yield connection
    connection.close()


def cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_a_check():
    assert QUERIES.keys() == CHECKS.keys()
    assert QUERIES.keys() <= entry_point.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_check(spark, testdata, db, name):
    df = QUERIES[name](spark, testdata)
    result = db.sql(CHECKS[name])
    got, want = normal(df.columns, df.collect()), normal(result.columns, result.fetchall())
    assert got == want
    assert got[1]


def test_entry(spark, testdata):
    assert entry_point.entry(spark).count() == 5
