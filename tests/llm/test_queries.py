"""The registered queries that have SQL, beside it, on the smallest tables; all others run."""

import os

import duckdb
import pytest

from surelake.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(repr(list(r)) for r in df.select(*columns).collect())
    assert found
    if name in queries.oracle_sql():
        result = duck.sql(queries.oracle_sql()[name])
        assert sorted(result.columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert found == sorted(repr(list(r)) for r in result.select(quoted).fetchall())
