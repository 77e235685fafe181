import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmill.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, db, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = db.execute(core.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted({*core.QUERIES} - {*core.ORACLES}))
def test_query_runs(spark, name):
    core.QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}
