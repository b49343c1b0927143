"""Run a named query and its oracle side by side and compare the tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return v.date()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _sort_key(row):
    return tuple((v is not None, type(v).__name__ if v is not None else "", repr(v)) for v in row)


def _zeros(row):
    """Signs of the zeros of a row: -0.0 and 0.0 are equal but print differently."""
    return [math.copysign(1, v) for v in row if isinstance(v, float) and v == 0]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=_sort_key)


def compare(df, sql: str, con) -> str | None:
    """None when equal, otherwise what differs. Values are compared exactly."""
    left_cols, left = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    spark_types = dict(df.dtypes)
    duck_types = {d[0]: str(d[1]).lower() for d in cur.description}
    kinds = {"integer": "int", "varchar": "string", "timestamp": "timestamp_ntz"}
    wrong = {c: (t, duck_types[c]) for c, t in spark_types.items()
             if c in duck_types and "[" not in duck_types[c] and kinds.get(duck_types[c], duck_types[c]) != t}
    if wrong:
        return f"column types differ: {wrong}"
    right_cols, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"row count {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b or _zeros(a) != _zeros(b)]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[:2]}"
    types = [
        (c, type(a).__name__, type(b).__name__)
        for a, b in zip(left[:50], right[:50])
        for c, a, b in zip(left_cols, a, b)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    return f"types differ: {types[:3]}" if types else None
