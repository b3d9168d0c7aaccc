"""Running a query beside its SQL."""

from __future__ import annotations

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def duck(path: str = DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(path):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def same(df, c, sql: str) -> None:
    r = c.execute(sql)
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(tuple(plain(row[columns.index(k)]) for k in sorted(columns)) for row in r.fetchall())
    ours = sorted(tuple(plain(row[k]) for k in sorted(columns)) for row in df.collect())
    assert len(ours) == len(theirs)
    assert ours == theirs
