"""Queries against their SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from lociforge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(x):
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want
