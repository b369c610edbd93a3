"""Compare a query's rows in Spark with those of its SQL in DuckDB, regardless of row and column order."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, int):
        return float(v) if abs(v) < 1 << 53 else v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((repr(tuple(plain(r[i]) for i in order)) for r in data))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(df, con, sql: str) -> str:
    """Empty if both agree."""
    rel = con.sql(sql)
    want_names, want = rows(rel.columns, rel.fetchall())
    got_names, got = rows(df.columns, df.collect())
    if want_names != got_names:
        return f"columns {got_names} and {want_names}"
    if want != got:
        a, b = set(want), set(got)
        return f"{len(got)} and {len(want)} rows; only Spark {sorted(b - a)[:2]}; only SQL {sorted(a - b)[:2]}"
    return ""
