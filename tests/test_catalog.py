"""Every registered query with SQL gives the SQL's rows, on the smallest tables."""

import math
import os

import pytest

from sparkclade.plans import catalog, combined, more, roundtrips, wide  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (bool, str)) or v is None:
        return v
    f = float(v)
    return repr(f)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_is_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
