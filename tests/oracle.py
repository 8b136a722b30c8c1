"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs (values must be identical)."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    wcols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if cols != wcols:
        return f"columns {cols} != {wcols}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(cols, got[0], want[0]) if type(a) is not type(b)]
    return f"types {types}" if types else None
