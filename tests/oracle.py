"""Comparison of a DataFrame with DuckDB's SQL over the same tables."""

import datetime as dt
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.sql(sql)
    return r.columns, r.fetchall()


def same(df, sf_dir: str, sql: str) -> None:
    names = sorted(df.columns)
    columns, rows = duck(sf_dir, sql)
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rows)
