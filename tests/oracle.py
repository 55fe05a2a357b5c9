"""Comparing a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


def same(spark, con, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
    return sum(got.values())
