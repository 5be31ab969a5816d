"""A query's result against its SQL oracle in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6) + 0.0
        elif not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].map(str)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def same(spark_df, sql, connection):
    a, b = plain(spark_df.toPandas()), plain(connection.execute(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            x, y = a[c].astype(float), b[c].astype(float)
            assert (x.isna() == y.isna()).all() and ((x - y).abs().fillna(0) <= 1e-6 * y.abs().clip(lower=1).fillna(1)).all(), c
        else:
            assert (a[c] == b[c]).all(), c
