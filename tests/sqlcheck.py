"""Holds a query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from datetime import datetime

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def same(spark, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = connect().execute(sql)
    cols = [d[0] for d in found.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == want
