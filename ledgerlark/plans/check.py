"""Spark-vs-DuckDB comparison used by the tests and the check script.

Mirrors the driver's gate: same column names, same row count, and equal
order-insensitive hashes of the values (floats compared after rounding to 6
places, timestamps as ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = False   # True: floats compared at full precision (repr), not rounded


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0) if STRICT else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return ("DEC", round(float(v), 6))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _digest(cols, rows) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(keys).encode()).hexdigest()
    return len(keys), h


def compare(spark_df, sql: str, con) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(d_cols)
    _, hs = _digest(s_cols, s_rows)
    _, hd = _digest(d_cols, d_rows)
    out["hash_match"] = hs == hd
    out["match"] = out["columns_match"] and out["hash_match"] and len(s_rows) == len(d_rows)
    if not out["match"] and out["columns_match"]:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = {repr(tuple(_norm(r[i]) for i in order_s)) for r in s_rows}
        dd = {repr(tuple(_norm(r[i]) for i in order_d)) for r in d_rows}
        out["only_spark"] = sorted(ss - dd)[:3]
        out["only_oracle"] = sorted(dd - ss)[:3]
    return out
