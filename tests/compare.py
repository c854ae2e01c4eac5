"""Run a registered query and its SQL, and compare the rows whatever their order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, Decimal):
        return str(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_KINDS = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "FloatType": "FLOAT", "StringType": "VARCHAR",
          "BooleanType": "BOOLEAN", "DateType": "DATE", "TimestampNTZType": "TIMESTAMP", "TimestampType": "TIMESTAMP"}


def differences(frame, connection, sql) -> list[str]:
    """What differs; empty when names, types and rows agree."""
    found = connection.execute(sql)
    kinds = {d[0]: str(d[1]) for d in found.description}
    names, expected = _rows([d[0] for d in found.description], found.fetchall())
    ours, actual = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    if names != ours:
        return [f"columns {ours}, expected {names}"]
    notes = [
        f"{field.name} is {type(field.dataType).__name__}, expected {kinds[field.name]}"
        for field in frame.schema
        if _KINDS.get(type(field.dataType).__name__) != kinds[field.name]
    ]
    missing, extra = expected - actual, actual - expected
    if missing or extra:
        notes.append(
            f"rows {sum(actual.values())}, expected {sum(expected.values())}; {sum(missing.values())} missing such as"
            f" {list(missing)[:2]}, {sum(extra.values())} extra such as {list(extra)[:2]}"
        )
    return notes
