"""Hold a query's rows against those of its SQL equivalent, in any order."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs: column names, number of rows, the first few rows."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = rows(want_names, cur.fetchall())
    out = []
    if sorted(df.columns) != sorted(want_names):
        out.append(f"columns {sorted(df.columns)} != {sorted(want_names)}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        out.append(f"only in the query ({len(a - b)}): {sorted(a - b)[:3]}")
        out.append(f"only in SQL ({len(b - a)}): {sorted(b - a)[:3]}")
    return out
