"""Every query with an oracle gives the oracle's rows; the others give rows."""

import math
import os

import duckdb
import pytest

from ledgerlark.plans import QUERIES
from ledgerlark.plans.views import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    got = q.build(spark, SF)
    rows = got.collect()
    if not q.sql:
        assert got.columns
        return
    cur = duck.execute(q.sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert table(got.columns, rows) == want
