"""Run a registered query and its oracle side by side."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("float", repr(v))
    if isinstance(v, (str, type(None))):
        return (type(v).__name__, v)
    if isinstance(v, (dt.datetime, dt.date)):
        return ("time", v.isoformat())
    return (type(v).__name__, repr(v))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def compare(df, con, sql: str) -> tuple[bool, str, int]:
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}: {set(got) ^ set(want) and list(set(got) ^ set(want))[:4]}", len(got)
    if got != want:
        return False, f"values {[(a, b) for a, b in zip(got, want) if a != b][:3]}", len(got)
    return True, "", len(got)
