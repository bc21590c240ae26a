"""Queries with SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from oremill.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = [pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables"), pytest.mark.usefixtures("shipped_plans")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    r = duck.execute(oracle.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    shown = lambda rows: sorted(tuple(str(v) for v in x) for x in rows)
    assert shown(df.collect()) == shown([tuple(x[i] for i in at) for x in r.fetchall()])


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - oracle.oracle_sql().keys()))
def test_other_queries_run(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0
