"""Runs a query's SQL in DuckDB and compares the two results as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.sources import SCHEMAS

DUCK_TYPES = {
    "BIGINT": T.LongType, "INTEGER": T.IntegerType, "DOUBLE": T.DoubleType,
    "VARCHAR": T.StringType, "BOOLEAN": T.BooleanType, "DATE": T.DateType,
    "TIMESTAMP": T.TimestampNTZType, "VARCHAR[]": T.ArrayType,
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in SCHEMAS:
        # one file, or a folder of files as Spark writes it
        table = f"{folder}/{name}.parquet"
        files = f"{table}/*.parquet" if os.path.isdir(table) else table
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows(columns: list[str], found) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in found)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    found = []
    if sorted(relation.columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(relation.columns)}"]
    duck = dict(zip(relation.columns, relation.types))
    for field in df.schema:
        wanted = DUCK_TYPES.get(str(duck[field.name]))
        if wanted is None or not isinstance(field.dataType, wanted):
            found.append(f"type of {field.name}: {field.dataType} != {duck[field.name]}")
    expected = rows(relation.columns, relation.fetchall())
    actual = rows(df.columns, df.collect())
    if len(expected) != len(actual):
        found.append(f"{len(actual)} rows != {len(expected)}")
    wrong = [pair for pair in zip(actual, expected) if pair[0] != pair[1]]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
