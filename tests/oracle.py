"""Compare registered queries with their SQL on the driver tables."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, fn, sql, sf_dir, con=None):
    """Return (matches, message)."""
    con = con or connect(sf_dir)
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    t2 = time.time()
    stats = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(cols, want)
    for x, y in zip(a, b):
        if x != y:
            return False, f"{sorted(cols)}: {x} vs {y}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE"}
    odd = {c: (t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]}
    return (not odd), stats + (f" TYPES {odd}" if odd else "")
