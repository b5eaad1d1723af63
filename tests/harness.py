"""Compare a Spark query with its DuckDB oracle: row count, column names, sorted values."""
from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(round(v, 6)))
    if isinstance(v, (list, tuple)):
        return (1, repr([_norm(x) for x in v]))
    if isinstance(v, dict):
        return (1, repr(sorted((k, _norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return (1, repr(v))


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(spark_df.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in spark_df.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    if sorted(dcols) != cols:
        return False, f"columns differ: spark={cols} duck={sorted(dcols)}"
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    ss, dd = sorted(srows), sorted(drows)
    if ss != dd:
        for a, b in zip(ss, dd):
            if a != b:
                return False, f"first diff: spark={a} duck={b}"
    return True, f"{len(srows)} rows"
