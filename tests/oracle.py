"""Run named queries next to their SQL and compare schema, row count and values."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool",
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "hugeint", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool",
    "SMALLINT": "int",
}


def compare(spark, con, folder: str, name: str, function, sql: str) -> str | None:
    """A description of the first difference, or None."""
    df = function(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {c: str(t) for c, t in df.dtypes}
    sql_kinds = {d[0]: str(d[1]) for d in result.description}
    for c in columns:
        a, b = KINDS.get(kinds[c], kinds[c]), KINDS.get(sql_kinds[c], sql_kinds[c])
        if a != b and not sql_kinds[c].startswith("DECIMAL") and b != "hugeint":
            return f"type of {c}: {kinds[c]} != {sql_kinds[c]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sorted(columns)}: {a} != {b}"
    if not got:
        return "no rows"
    return None
