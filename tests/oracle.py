"""Side-by-side comparison of a query with its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{round(v, 5) + 0.0:.5f}"
    if isinstance(v, bool) or v is None:
        return str(v).lower() if v is not None else "null"
    return f"{float(v):.5f}" if type(v).__name__ == "Decimal" else str(v)


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
