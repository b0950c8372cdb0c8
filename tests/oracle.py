"""Order-insensitive comparison of a query with its SQL on the same tables."""

import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def compare(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    spark_rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql_rows = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert spark_rows == sql_rows
    return len(spark_rows)
