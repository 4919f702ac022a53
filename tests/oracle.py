"""Runs queries and their SQL over one folder and compares rows, ignoring order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((x is None, 0.0 if isinstance(x, float) and math.isnan(x) else (round(x, 6) + 0.0 if isinstance(x, float) else x)) for x in row)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: columns, counts or rows. Empty if nothing does."""
    cols = sorted(df.columns)
    got = sorted((_key(tuple(r)) for r in df.select(*cols).collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return [f"columns {cols} and {sorted(names)}"]
    order = [names.index(c) for c in cols]
    want = sorted((_key(tuple(r[i] for i in order)) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return [f"{len(got)} and {len(want)} rows, first {got[:1]} and {want[:1]}"]
    out = []
    for g, w in zip(got, want, strict=True):
        if g != w and not all(a == b or (isinstance(a[1], float) and isinstance(b[1], float) and abs(a[1] - b[1]) < 2e-6) for a, b in zip(g, w, strict=True)):
            out.append(f"{g} and {w}")
            if len(out) > 2:
                break
    return out
