"""Running a query and its SQL side by side."""

from __future__ import annotations

import decimal
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def connection(folder: str = DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{folder}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else float(f"{v:.12g}")
    return str(v) if isinstance(v, decimal.Decimal) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def same(df, con, sql):
    """Both sides have the same columns, types and rows."""
    want = con.sql(sql)
    kinds = {c: TYPES.get(k, k) for c, k in df.dtypes}
    assert kinds == {c: str(k) for c, k in zip(want.columns, want.types)}
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
