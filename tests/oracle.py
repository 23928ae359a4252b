"""Runs a query's SQL in DuckDB and compares it with the rows of Spark."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(x):
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


def difference(df, con, sql):
    """None if rows and columns are the same, else what differs."""
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {names}"
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    if want == got:
        return None
    return f"Spark only {list((got - want).items())[:3]}, SQL only {list((want - got).items())[:3]}"
