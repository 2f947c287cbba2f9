"""Every named query against its SQL, on the smallest stored tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import load_catalog
from corpusloom.sources.tables import SCHEMAS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = load_catalog()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no stored tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(CATALOG.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = CATALOG.QUERIES[name](spark, SF_DIR)
    got = lines(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(CATALOG.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == lines(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(CATALOG.QUERIES) - set(CATALOG.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert CATALOG.QUERIES[name](spark, SF_DIR).count() > 0
