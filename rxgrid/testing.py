"""Result comparison used by tests and the oracle check script."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from rxgrid.sources.adapter import BASE_TABLES


def duckdb_conn(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    import decimal
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v)
    return v


def _coarse(x):
    if isinstance(x, float):
        return f"{x:.3g}"
    return str(x)


def _close(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= 1e-6 * max(1.0, abs(x), abs(y))
    return x == y


def _close_row(a, b) -> bool:
    return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))


def normalise_rows(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    # sort on non-float values first, then coarse floats, so tiny float noise
    # does not reorder rows
    return sorted(out, key=lambda t: (tuple((x is None, str(x)) for x in t if not isinstance(x, float)),
                                      tuple(_coarse(x) for x in t)))


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    res = {
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in d_cols),
    }
    if res["columns_match"]:
        a = normalise_rows(s_cols, s_rows)
        b = normalise_rows(d_cols, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if not _close_row(x, y)]
        res["values_match"] = len(a) == len(b) and not diff
        if diff:
            res["first_diff"] = diff[:3]
    else:
        res["spark_cols"] = sorted(s_cols)
        res["oracle_cols"] = sorted(d_cols)
        res["values_match"] = False
    return res
