"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's gate).

Both results are normalised (floats rounded, timestamps as ISO text,
decimals as floats), columns sorted by name and rows sorted, then compared
as multisets.  Used on small fixtures only; never on a cluster.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

from .session import TABLES


def _norm(v, places=4):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, places)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, places)) for k, x in v.items()))
    if hasattr(v, "item"):
        return _norm(v.item(), places)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of_duck(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    return cols, [tuple(_norm(r[i]) for i in order) for r in data]


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def compare(spark_rows, duck_rows) -> dict:
    (sc, sr), (dc, dr) = spark_rows, duck_rows
    out = {"spark_rows": len(sr), "oracle_rows": len(dr), "columns_match": sc == dc,
           "spark_cols": sc, "oracle_cols": dc}
    ok = sc == dc and len(sr) == len(dr)
    if ok:
        a = sorted(sr, key=_key)
        b = sorted(dr, key=_key)
        mism = [(x, y) for x, y in zip(a, b) if x != y]
        out["value_mismatches"] = len(mism)
        out["examples"] = mism[:3]
        ok = not mism
    out["match"] = ok
    return out
