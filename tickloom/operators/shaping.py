"""Casts, renames, filters and other projections."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from datetime import date
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.segments import free_name
from tickloom.session import written_counted

_TOO_MANY = "the query gives more than"


def strict_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns; a value that does not fit or a column that does not exist is an error."""
    if df.sparkSession.conf.get("spark.sql.ansi.enabled") != "true":
        raise ValueError("strict casts need spark.sql.ansi.enabled, otherwise bad values become null")
    missing = [name for name in types if name not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; names the frame does not have are ignored."""
    return df.withColumnsRenamed(dict(names))


def all_of(conditions: Sequence[str | Column]) -> Column:
    """Conjunction of predicates given as SQL texts or columns. An empty list is refused."""
    if not conditions:
        raise ValueError("at least one condition is required")
    columns = [F.expr(c) if isinstance(c, str) else c for c in conditions]
    return functools.reduce(operator.and_, columns)


def since(df: DataFrame, date_column: str, as_of: date, days: int) -> DataFrame:
    """Rows of the last ``days`` days; the bound is a literal, so date partitions are pruned."""
    return df.filter(F.col(date_column) >= F.date_sub(F.lit(as_of), days))


def strictly_between(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    return df.filter((F.col(column) > F.lit(low)) & (F.col(column) < F.lit(high)))


def stamp(df: DataFrame, **values: object) -> DataFrame:
    """Add constant columns, such as the time of the run."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def latest_rows(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` rows with the largest ``order`` values, largest first."""
    return df.orderBy(*[F.col(name).desc() for name in order]).limit(limit)


def run_statements(spark: SparkSession, statements: Sequence[tuple[str, Mapping[str, object]]]) -> DataFrame:
    """Run parameterised statements in order and return the result of the last.

    Values are bound as named parameters (``:name``, ``IDENTIFIER(:name)``), never pasted into the text.
    """
    if not statements:
        raise ValueError("at least one statement is required")
    result = None
    for text, args in statements:
        result = spark.sql(text, args=dict(args))
    return result


def statement_text(query: str | None = None, path: str | None = None) -> str:
    """A statement given as text or as the path of a file on the driver; exactly one of the two."""
    if (query is None) == (path is None):
        raise ValueError("give either query or path")
    return Path(path).read_text(encoding="utf-8") if path is not None else query


def guarded_select(
    spark: SparkSession,
    query: str | None = None,
    *,
    limit: int,
    args: Mapping[str, object] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Run a parameterised query; the caller must say how many rows it gives at most. More are an error, none is cut.

    The query runs once: its rows are written, counted by the tasks that write them and read back in the query's order, so the
    rows returned are those that were counted.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    found = spark.sql(statement_text(query, path), args=dict(args or {}))
    place = free_name(found, "place")
    numbered = found.withColumn(place, F.monotonically_increasing_id())
    # The lower bits count the rows of a task, so a task that alone has too many ends the run early.
    message = F.lit(f"{_TOO_MANY} {limit} rows")
    sound = F.when(F.col(place).bitwiseAND((1 << 33) - 1) < limit, True).otherwise(F.raise_error(message).cast("boolean"))
    try:
        rows, count = written_counted(numbered.filter(sound), "guarded")
    except PySparkException as error:
        if _TOO_MANY in str(error):
            raise ValueError(f"{_TOO_MANY} {limit} rows") from None
        raise
    if count > limit:
        raise ValueError(f"{_TOO_MANY} {limit} rows")
    return rows.orderBy(place).drop(place)
