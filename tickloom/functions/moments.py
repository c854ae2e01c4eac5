"""Dates, epochs and time zones. All times are UTC."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two text formats of a scrape time.
RECORD_FORMAT = "yyyy-MM-dd HH:mm:ss"
FILE_FORMAT = "yyyyMMdd_HHmmss"
_BEYOND_LONG = Decimal(2**64)
# Below every ordinal: a row without a time comes first.
_BEFORE_ALL_TIMES = Decimal(-(10**37))
_TIMES = (T.TimestampType, T.TimestampNTZType)


def look_back_start(as_of: Column, days: int) -> Column:
    """First date of a look-back of ``days`` days that ends at ``as_of``."""
    return F.date_sub(as_of, days)


def utc_day(moment: Column) -> Column:
    return F.date_trunc("day", moment)


def order_value(df: DataFrame, order: Sequence[str]) -> Column | None:
    """The columns ``order`` as one value of fixed width that sorts alike, nulls first; None where their types allow none.

    Such a value stays in hash aggregation, where a struct forces sorting: a time with a whole number, or a single column of
    fixed width.
    """
    kinds = [df.schema[name].dataType for name in order]
    if len(order) == 1 and isinstance(kinds[0], (*_TIMES, T.NumericType, T.DateType)):
        return F.col(order[0])
    if len(order) == 2 and isinstance(kinds[0], _TIMES) and isinstance(kinds[1], T.IntegralType):
        number = F.coalesce(F.col(order[1]).cast("long"), F.lit(-(1 << 63)))
        return F.coalesce(ordinal(F.col(order[0]), number), F.lit(_BEFORE_ALL_TIMES) + number.cast("decimal(19,0)"))
    return None


def to_millis(moment: Column) -> Column:
    return F.unix_millis(moment.cast("timestamp"))


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def ordinal(moment: Column, number: Column) -> Column:
    """One number that orders by time, then by a 64-bit number.

    As the order of ``min_by`` and ``max_by`` it keeps them in hash aggregation; a struct forces sorting.
    """
    micros = F.unix_micros(moment.cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit(_BEYOND_LONG) + number.cast("decimal(19,0)")


def in_zone(moment: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of a zone-less UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)


def record_text(moment: Column) -> Column:
    return F.date_format(moment, RECORD_FORMAT)


def file_text(moment: Column) -> Column:
    return F.date_format(moment, FILE_FORMAT)
