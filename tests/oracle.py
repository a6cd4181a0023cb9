"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

from stratalode.catalog import BASE_TABLES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        v = round(v, 9)
        return int(v) if v == int(v) else v
    return v if isinstance(v, int) else str(v)


def duck(sf_dir):
    c = duckdb.connect()
    for t in BASE_TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(df, sql, sf_dir):
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    r = duck(sf_dir).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())
    assert got == want
