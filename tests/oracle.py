"""Holds a query's rows against DuckDB's, as a multiset over columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(d: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(d).iterdir():
        if p.suffix == ".parquet":
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con) -> str:
    """Empty if alike, else what differs."""
    cols, mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    theirs_cols, theirs = rows_of([x[0] for x in cur.description], cur.fetchall())
    if cols != theirs_cols:
        return f"columns {cols} / {theirs_cols}"
    if mine == theirs:
        return ""
    a, b = mine - theirs, theirs - mine
    return f"{sum(mine.values())} / {sum(theirs.values())} rows; only here {sum(a.values())}: {list(a)[:3]}; only there {sum(b.values())}: {list(b)[:3]}"
