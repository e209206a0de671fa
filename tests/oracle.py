"""Compares a registered query with its SQL in DuckDB, and lists what differs."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return str(v)


def compare(spark, name, fn, sql, sf_dir=SF) -> str:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    res = connect(sf_dir).execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in res.fetchall())
    if got != want:
        extra = [x for x in got if x not in set(want)][:2]
        lack = [x for x in want if x not in set(got)][:2]
        return f"{name}: {len(got)} against {len(want)} rows; only here {extra}; only in SQL {lack}"
    return ""
