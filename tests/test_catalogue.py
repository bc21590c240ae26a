"""Every query with SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from oremill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = [pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables"), pytest.mark.usefixtures("shipped_plans")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(str(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    r = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns, sorted(columns)) == plain(r.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_other_queries_run(spark, name):
    catalogue.queries()[name](spark, FOLDER).collect()
