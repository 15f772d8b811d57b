"""Comparing a query with its SQL twin run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def normalised(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda row: tuple((cell is not None, str(cell)) for cell in row))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), normalised(df.columns, df.collect())


def oracle_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    return sorted(columns), normalised(columns, cursor.fetchall())
