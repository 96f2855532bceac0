"""Compare a Spark result with the DuckDB result of its oracle, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """One spelling per value; numbers compare exactly, dates and midnights differ."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return ("number", decimal.Decimal(str(value)).normalize())
    if isinstance(value, dt.datetime):
        return ("moment", value.isoformat())
    if isinstance(value, dt.date):
        return ("day", value.isoformat())
    return ("text", str(value))


def as_bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def duck_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    rows = result.fetchall()
    con.close()
    return columns, rows


def differences(frame, sf_dir: str, sql: str) -> str | None:
    """None when both agree, otherwise what differs."""
    columns, expected = duck_rows(sf_dir, sql)
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    got, want = as_bag(frame.columns, [tuple(r) for r in frame.collect()]), as_bag(columns, expected)
    if got == want:
        return None
    extra, lacking = got - want, want - got
    return (
        f"{sum(got.values())} rows against {sum(want.values())}; {sum(extra.values())} extra, "
        f"{sum(lacking.values())} lacking; e.g. {list(extra)[:2]} / {list(lacking)[:2]}"
    )
