"""Rounding and unit conversion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves whose products are exact
_EXACT_LIMIT = 2251799813685248.0  # 2**51, below it a double can hold halves
_WHOLE = 4503599627370496.0  # 2**52, from there on a double is a whole number


def with_nearest(df: DataFrame, values: Mapping[str, Column], places: int) -> DataFrame:
    """Add double columns, rounded on their exact binary value with exact ties to the even digit.

    ``F.round`` rounds the shortest decimal text of a double with ties up, which differs on values such as
    2.675 (stored just below the tie). Here the rounding error of ``value * 10**places`` is recovered exactly
    (Dekker's product) and decides the direction, so no decimal type is needed. ``places`` may be 0 to 7. From
    2**51 on, where the scaled value cannot hold halves, the whole part is split off: the fraction has at most 25 binary
    places there, so that it can be scaled without error, and the sum of the two is off by no rounding of its own.

    The value and its two intermediate results occur several times in the formula. Each is a column first, which
    computes it once and keeps the generated code below the size the JVM compiles.
    """
    if not 0 <= places <= 7:
        raise ValueError("places must be between 0 and 7")
    scale, split = f"{10**places}.0D", f"{_SPLIT!r}D"
    parts, rounded = {}, {}
    for name in values:
        x, scaled, high = f"`{name}`", f"`{name}__scaled`", f"`{name}__high`"
        parts[f"{name}__scaled"] = F.expr(f"{x} * {scale}")
        parts[f"{name}__high"] = F.expr(f"{x} * {split} - ({x} * {split} - {x})")
        error = f"({high} * {scale} - {scaled} + ({x} - {high}) * {scale})"
        excess = f"({scaled} - floor({scaled}) - 0.5D + {error})"
        nearest = f"rint(floor({scaled}) + 0.5D + 0.5D * signum({excess})) / {scale}"
        large = f"floor({x}) + rint(({x} - floor({x})) * {scale}) / {scale}" if places else f"rint({x})"
        rounded[name] = F.expr(
            f"CASE WHEN abs({scaled}) < {_EXACT_LIMIT!r}D THEN {nearest} WHEN abs({x}) < {_WHOLE!r}D THEN {large} ELSE {x} END"
        )
    return df.withColumns(dict(values)).withColumns(parts).withColumns(rounded).drop(*parts)


def whole(value: Column) -> Column:
    """SQL ``ROUND(x)``: nearest integer as a double, halves away from zero."""
    return F.round(value, 0)


def floor_to(value: Column, places: int) -> Column:
    """Cut to ``places`` decimals towards minus infinity."""
    scale = float(10**places)
    return F.floor(value * F.lit(scale)) / F.lit(scale)


def megabytes(size_in_bytes: Column) -> Column:
    return size_in_bytes / F.lit(1024.0 * 1024.0)


def seconds(milliseconds: Column) -> Column:
    return milliseconds / F.lit(1000.0)
