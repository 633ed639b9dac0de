"""Every registered query beside its SQL, on the smallest tables."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from surelake.plans import catalog

FOLDER = entry.SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert found
    result = duck.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = sorted(repr([plain(v) for v in r]) for r in result.select(quoted).fetchall())
    assert found == expected


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())


def test_full_bootstrap_equals_brute_force(spark, tmp_path):
    ids = range(40)
    spark.createDataFrame([(i,) for i in ids], "doc_id bigint").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, "en") for i in ids], "doc_id bigint, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    right = lambda i, k: (i + 3 * k) % 7 != 0 and i * (k + 2) % 5 < 3
    diffs = sorted(right(i, 2) - right(i, 1) for i in ids)
    place = lambda r, i: int(hashlib.sha256(f"11:{r}:{i}".encode()).hexdigest()[:12], 16) % len(diffs)
    means = sorted(sum(diffs[place(r, i)] for i in ids) / len(diffs) for r in range(5000))
    r = catalog.queries()["bootstrap_ci_full"](spark, str(tmp_path)).first()
    assert (r.n, r.delta, r.ci_low, r.ci_high) == (len(diffs), *(pytest.approx(x, abs=1e-6) for x in (sum(diffs) / len(diffs), means[125], means[4874])))
