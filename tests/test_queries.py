"""Registered queries against their SQL, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(row):
    return tuple("None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(shown(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        want = sorted(shown([r[i] for i in order]) for r in rel.fetchall())
        assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
