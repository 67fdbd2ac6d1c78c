"""Runs a query and its SQL twin, and compares their rows."""

from __future__ import annotations

import math
from datetime import date, datetime, timezone
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, df.collect())


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    found = duckdb_connection(sf_dir).execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())
