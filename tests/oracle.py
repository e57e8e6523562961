"""Compare a registered query with its oracle SQL, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float" if isinstance(v, float) else "decimal"
    if isinstance(v, dt.datetime):
        return "datetime"
    return type(v).__name__


def canonical(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple((kind(r[i]), canonical(r[i])) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def differences(df, con, sql: str) -> list[str]:
    left_names, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right_names, right = rows_of(names, cur.fetchall())
    if left_names != right_names:
        return [f"columns {left_names} != {right_names}"]
    if len(left) != len(right):
        extra = [x for x in left if x not in set(right)][:2]
        lack = [x for x in right if x not in set(left)][:2]
        return [f"rows {len(left)} != {len(right)}; spark only {extra}; oracle only {lack}"]
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return [f"{len(bad)} of {len(left)} rows differ, e.g. spark {a} oracle {b}" for a, b in bad[:2]]
