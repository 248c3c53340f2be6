"""Each query with SQL gives the rows of its SQL over the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def norm(v):
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return v
    return None if math.isnan(v) else round(float(v), 5)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_like_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    r = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(map(norm, x)) for x in r.fetchall()), key=repr)
    got = sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
