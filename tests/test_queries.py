"""Registered queries against their SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 4) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(names) == sorted(got.columns)
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
