"""Realised profit and loss."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REALIZED = "REALIZED_PNL"


def bounds(start: datetime | None, end: datetime | None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The given range, or today from UTC midnight until now when neither end is given."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    if start is not None and end is not None:
        return start, end
    end = now or datetime.now(UTC).replace(tzinfo=None)
    return end.replace(hour=0, minute=0, second=0, microsecond=0), end


def realized(income: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Realised income in the range, both ends included, at millisecond resolution.

    The bounds are literals on the bare time column, so the filter reaches the file scan.
    """
    first = start.replace(microsecond=start.microsecond // 1000 * 1000)
    past = end.replace(microsecond=end.microsecond // 1000 * 1000) + timedelta(milliseconds=1)
    time = F.col("income_time")
    return income.filter((F.col("income_type") == REALIZED) & (time >= F.lit(first)) & (time < F.lit(past)))


def total_pnl(income: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row: realised profit in the range, 0 without any."""
    return realized(income, start, end).agg(_total())


def daily_pnl(income: DataFrame) -> DataFrame:
    """Realised profit per UTC day and symbol."""
    return (
        income.filter(F.col("income_type") == REALIZED)
        .groupBy(F.to_date("income_time").alias("day"), "symbol")
        .agg(_total(), F.count(F.lit(1)).alias("entries"))
    )


def _total() -> Column:
    return F.coalesce(F.sum("income"), F.lit(0.0)).alias("pnl")
