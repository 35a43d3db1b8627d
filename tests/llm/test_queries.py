"""The registered queries on the smallest tables, against SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from stowage.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "conversations", "embeddings"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([clean(row[i]) for i in order]) for row in rows)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE_SQL) <= set(entry_points.oracle_sql())
    assert "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLE_SQL[name])
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == want
