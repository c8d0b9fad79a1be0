"""Holds Spark queries against DuckDB on the same tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([_plain(x) for x in v])
    if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(int(v))
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_plain(v) for v in r) for r in df[cols].itertuples(index=False))


def same(spark_df, con, sql):
    a, b = rows(spark_df.toPandas()), rows(con.execute(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
