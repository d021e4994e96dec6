"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import collections
import datetime
import decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con, sql):
    cursor = con.execute(sql)
    return bag([d[0] for d in cursor.description], cursor.fetchall())
