"""Every query beside its SQL twin on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from textloom.plans import more  # noqa: F401  registers its queries
from textloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(repr(float(x) if isinstance(x := plain(v[k]), (int, float)) and not isinstance(x, bool) else x) for k in order) for v in values))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())
