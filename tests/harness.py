"""Compare a query with its SQL on the same tables: columns, rows, values in any order."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if math.isfinite(v) and v == int(v) else round(v, 9)
    if isinstance(v, (datetime, date)):
        return str(v)
    return v


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in records], key=repr)


def differences(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    result = con.sql(sql)
    want_columns, got_columns = sorted(result.columns), sorted(df.columns)
    if want_columns != got_columns:
        return f"columns {got_columns} and {want_columns}"
    want, got = rows_of(result.fetchall(), result.columns), rows_of(df.collect(), df.columns)
    if len(want) != len(got):
        return f"{len(got)} and {len(want)} rows; only here {list(set(got) - set(want))[:2]}, only there {list(set(want) - set(got))[:2]}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} of {len(got)} rows differ, such as {wrong[:2]}" if wrong else None
