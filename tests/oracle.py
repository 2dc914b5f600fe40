"""Runs a query and its SQL side by side."""

import math
import os

import duckdb

from rill.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=key)


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def same(df, sql, con):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows([c[0] for c in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
