"""Holds a query's rows against its SQL in DuckDB."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd

FOLDER = os.environ.get("NAVA_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return str(value.date()) if value == value.normalize() else str(value)
    if isinstance(value, datetime.date):
        return str(value)
    if isinstance(value, (float, np.floating)):
        return round(float(value), 6)
    return value.item() if isinstance(value, np.generic) else value


def differences(spark, query, sql) -> list[str]:
    """What differs: columns, types or rows; empty if nothing does."""
    df = query(spark, FOLDER)
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    other = con.sql(sql)
    types = {c: str(t) for c, t in zip(other.columns, other.types)}
    out = [f"{c}: {k} and {types.get(c)}" for c, k in df.dtypes if KINDS.get(k) != types.get(c)]
    if sorted(df.columns) != sorted(types):
        return [f"columns {sorted(df.columns)} and {sorted(types)}"]
    rows = lambda frame: sorted((tuple(plain(v) for v in r) for r in frame[sorted(types)].itertuples(index=False, name=None)), key=repr)
    a, b = rows(df.toPandas()), rows(other.df())
    if a != b:
        out.append(f"{len(a)} and {len(b)} rows, first {next(((x, y) for x, y in zip(a, b) if x != y), None)}")
    return out
