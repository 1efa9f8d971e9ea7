"""Compare a Spark result with DuckDB SQL on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return "None" if v is None or pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame, columns):
    return sorted(tuple(map(value, r)) for r in frame[columns].astype(object).values.tolist())


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from read_parquet('{path}')")
    got, want = df.toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
