"""Runs a registered query and its DuckDB counterpart and compares their rows."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(_value, x)) if isinstance(x, list) else x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    res = connection(sf_dir).execute(sql)
    want = rows([c[0] for c in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in res.description)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)) for a, b in zip(g, w)), (g, w)
