"""Every registered query of the image-flow operators against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowtab.plans import queries as base

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, con, name):
    df = base.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    assert got
    if name in base.ORACLE_SQL:
        want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({base.ORACLE_SQL[name]})").fetchall()
        assert plain(got) == plain(want)


def test_entry(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
