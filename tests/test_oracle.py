"""Every query with SQL gives DuckDB's rows at the smallest size."""

from __future__ import annotations

import os

import pytest

from quillstream.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_rows_equal_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLE[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    expected = sorted(tuple(repr(r[cols.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(repr(r[c]) for c in order) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_queries_without_sql_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
