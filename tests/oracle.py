"""Comparison of a query with its oracle SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def tables(con: duckdb.DuckDBPyConnection, folder: str) -> None:
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")


def _cell(x) -> str:
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(pdf) -> list[tuple[str, ...]]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(_cell, r)) for r in pdf.astype(object).itertuples(index=False))


def same(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    tables(con, folder)
    want, got = con.execute(sql).df(), query(spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
