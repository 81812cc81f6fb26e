"""Run a registered query on Spark and its SQL on DuckDB, compare the results.

Used by the tests and while developing; it mirrors the driver's gate:
same column names, same row count, same multiset of rows (floats rounded).
"""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, digits)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def rows_of(pdf, digits=6):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(v, digits) for v in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def _kind(series) -> str:
    """Coarse type of a result column: int / float / str / other.  Integer
    widths are told apart since a driver may compare schemas strictly."""
    k = str(series.dtype)
    if series.isna().all():
        return "null"
    if k.startswith(("int", "Int")):
        return "int" + "".join(ch for ch in k if ch.isdigit())
    if k.startswith(("float", "Float")):
        return "float"
    return "obj"


def _spark_kind(t) -> str:
    n = t.typeName()
    return {"integer": "int32", "long": "int64", "short": "int16", "byte": "int8",
            "double": "float64", "float": "float32", "string": "str", "boolean": "bool"}.get(n, n)


def _duck_kind(t) -> str:
    n = str(t).upper()
    return {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8",
            "DOUBLE": "float64", "FLOAT": "float32", "VARCHAR": "str", "BOOLEAN": "bool"}.get(n, n)


def compare(spark_df, sql: str, sf_dir: str, digits: int = 6) -> tuple[bool, str]:
    s = spark_df.toPandas()
    rel = duck(sf_dir).sql(sql)
    d = rel.df()
    sc, sr = rows_of(s, digits)
    dc, dr = rows_of(d, digits)
    if sc != dc:
        return False, f"columns differ: spark={sc} duckdb={dc}"
    sk = {f.name: _spark_kind(f.dataType) for f in spark_df.schema.fields}
    dk = {n: _duck_kind(t) for n, t in zip(rel.columns, rel.types)}
    if sk != dk:
        diff = {c: (sk[c], dk[c]) for c in sc if sk[c] != dk[c]}
        return False, f"column types differ (spark, duckdb): {diff}"
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duckdb={len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return False, f"first differing row: spark={a} duckdb={b}"
    return True, f"{len(sr)} rows match"
