"""Side-by-side check of a Spark result against DuckDB SQL on the same parquet."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

from sparkstats.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0:
            return 0.0
        return float(f"{v:.{digits}g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "toArray"):
        return tuple(_norm(float(x), digits) for x in v.toArray())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if type(v).__name__ == "Decimal":
        return _norm(float(v), digits)
    return v


def normalise(columns, rows, digits=9):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                 for x in r))
    return cols, out


def compare(spark_df, con, sql, digits=9):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    sc, sr = normalise(s_cols, s_rows, digits)
    dc, dr = normalise(d_cols, d_rows, digits)
    assert sc == dc, f"columns differ: spark={sc} duckdb={dc}"
    assert len(sr) == len(dr), f"row counts differ: spark={len(sr)} duckdb={len(dr)}"
    for a, b in zip(sr, dr):
        assert a == b, f"row differs:\n spark={a}\n duck ={b}"
    return len(sr)
