"""Runs a registered query on Spark and its SQL on DuckDB and tells where the answers differ."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value) + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}: {got[1][:2]} / {want[1][:2]}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b:
            return f"{list(zip(got[0], a, b, strict=True))}"
    return None
