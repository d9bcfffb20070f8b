"""Side-by-side check of a registered query against its DuckDB oracle SQL.

Mirrors the driver's gate: row count, column names, and an order-insensitive
hash of the values with columns sorted by name.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def digest(cols: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark_df, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    sn, sh = digest(s_cols, s_rows)
    dn, dh = digest(d_cols, d_rows)
    out = {"rows_spark": sn, "rows_oracle": dn, "cols_match": sorted(s_cols) == sorted(d_cols),
           "hash_match": sh == dh}
    out["ok"] = out["cols_match"] and out["hash_match"] and sn == dn
    if not out["ok"]:
        order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        s_set = {repr(tuple(_norm(r[i]) for i in order)) for r in s_rows}
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        d_set = {repr(tuple(_norm(r[i]) for i in order_d)) for r in d_rows}
        out["spark_cols"] = s_cols
        out["oracle_cols"] = d_cols
        out["only_spark"] = sorted(s_set - d_set)[:3]
        out["only_oracle"] = sorted(d_set - s_set)[:3]
    return out
