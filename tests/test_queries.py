"""Every query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from pagewright import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        rel = con.sql(SQL[name])
        order = [list(rel.columns).index(c) for c in columns]
        assert len(rel.columns) == len(columns)
        assert got == sorted(str([plain(r[i]) for i in order]) for r in rel.fetchall())
    else:
        assert got


def test_whole_tables_are_read(spark, con):
    whole = {r["k"] for r in QUERIES["unseen_results_whole"](spark, DATA).collect()}
    shown = {r[0] for r in con.sql("SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'purchase'").fetchall()}
    assert not whole & shown
    replies = QUERIES["reply_spans_whole"](spark, DATA)
    assert replies.where("i > 0").count() > 0
    assert replies.where("i < 0").count() == 0
