"""Every registered query against its SQL counterpart on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from stowage.plans import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES = {name: run for name, run in entry_points.queries().items() if name in queries.QUERIES}
ORACLE = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 9) if isinstance(v, (float, Decimal)) else v
    return sorted(columns), sorted(repr([clean(row[i]) for i in order]) for row in rows)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(ORACLE[name])
    assert got == canonical([c[0] for c in cursor.description], cursor.fetchall())


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0
