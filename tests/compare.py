"""Runs a query's SQL in DuckDB over the same Parquet tables and compares the rows as multisets."""

import datetime
import decimal
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.6g}" if float(v) else "0"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def assert_same(df, sql, folder):
    names, rows = duck(sql, folder)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rows)
