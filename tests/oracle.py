"""Runs a registered query and its SQL on the same tables and compares all rows."""

import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in os.listdir(folder):
        file = f"{folder}/{p}" + ("/*.parquet" if os.path.isdir(f"{folder}/{p}") else "")
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(names: list[str], columns: list[str], rows: list) -> list[tuple]:
    at = [columns.index(c) for c in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, query, sql: str, folder: str) -> None:
    df = query(spark, folder)
    names = sorted(df.columns)
    got = rows_of(names, df.columns, df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert got == rows_of(names, columns, result.fetchall())
