"""Every registered query with SQL against DuckDB on a small scale."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


def value(v):
    return v if isinstance(v, bool) or v is None else round(v, 6) if isinstance(v, float) else v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
