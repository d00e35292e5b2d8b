"""Run a Spark result and a DuckDB SQL text on the same parquet tables and compare them.

Used by the tests; the comparison is order-insensitive, on columns sorted by name.
"""

from __future__ import annotations

import math
import os

from ..sources.tables import TABLES, table_path


def duckdb_frame(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = table_path(sf_dir, name)
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.sql(sql).df()


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd

        if v is pd.NaT or (not isinstance(v, (str, bytes, list, tuple, dict)) and pd.isna(v)):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, sql: str, sf_dir: str, rel_tol: float = 0.0):
    """Return (ok, message). rel_tol = 0 means exact equality of every value."""
    left = spark_df.toPandas()
    right = duckdb_frame(sql, sf_dir)
    lc, lr = rows_of(left)
    rc, rr = rows_of(right)
    if lc != rc:
        return False, f"columns differ: {lc} vs {rc}"
    if len(lr) != len(rr):
        return False, f"row counts differ: {len(lr)} vs {len(rr)}"
    bad = []
    for a, b in zip(lr, rr):
        if a == b:
            continue
        if rel_tol and all(_close(x, y, rel_tol) for x, y in zip(a, b)):
            continue
        bad.append((a, b))
    if bad:
        return False, f"{len(bad)} rows differ, first: {bad[0]}"
    return True, f"{len(lr)} rows equal"


def _close(x, y, tol):
    if isinstance(x, (int, float)) and isinstance(y, (int, float)):
        return math.isclose(x, y, rel_tol=tol, abs_tol=tol)
    return x == y
