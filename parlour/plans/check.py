"""Side-by-side check of a Spark result against its DuckDB oracle.

Mirrors the driver's gate: same column names, same row count, same multiset of rows once
columns are sorted by name and values are normalised (decimals and floats as rounded floats,
timestamps as ISO text).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        r = round(f, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return str(v)


def _duck_type(dt) -> str:
    return {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
            "DateType": "DATE", "TimestampNTZType": "TIMESTAMP", "BooleanType": "BOOLEAN",
            "DecimalType": "DECIMAL", "TimestampType": "TIMESTAMP WITH TIME ZONE"}.get(type(dt).__name__, str(dt))


def rows_of(cols: list[str], rows, digits: int):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark_df, con, sql: str, digits: int = 6) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_types = {d[0]: str(d[1]) for d in rel.description}
    d_rows = rel.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(s_cols), sorted(d_cols)
        res["ok"] = False
        return res
    s_types = {f.name: _duck_type(f.dataType) for f in spark_df.schema.fields}
    tm = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c].split("(")[0]}
    if tm:
        res["type_mismatch"] = tm
    a, b = rows_of(s_cols, s_rows, digits), rows_of(d_cols, d_rows, digits)
    res["values_match"] = a == b
    if not res["values_match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [r for r in a if r not in sb][:3]
        res["only_oracle"] = [r for r in b if r not in sa][:3]
    res["ok"] = res["values_match"] and len(s_rows) == len(d_rows)
    return res
