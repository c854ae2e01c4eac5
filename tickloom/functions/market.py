"""Formulas for leveraged positions."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (profit % that triggers the level, profit % the stop then locks in).
TRAILING_LEVELS = [
    (3, 1.5),
    (5, 3),
    (7, 5),
    (9, 7),
    (11, 9),
    (15, 12),
    (20, 18),
    (25, 20),
    (30, 25),
    (40, 35),
    (50, 45),
    (60, 55),
    (70, 65),
    (80, 75),
    (90, 85),
]
# Share of the balance to use, decimals of prices and quantities, distance at which two
# stops count as equal, and the retry ladder of a missing stop.
BALANCE_SHARE = 0.95
PRICE_PLACES = 2
QUANTITY_PLACES = 6
ORDER_PLACES = 3
STOP_TOLERANCE = 0.0001
LADDER_FIRST = 0.01
LADDER_STEP = 0.5
LADDER_LAST = 15
LADDER_LEVERAGE = 20


def side(amount: Column) -> Column:
    """LONG, SHORT, or null when flat."""
    return F.when(amount > 0, "LONG").when(amount < 0, "SHORT")


def closing_side(amount: Column) -> Column:
    """Order side that closes a position; null when flat."""
    return F.when(amount > 0, "SELL").when(amount < 0, "BUY")


def roi(amount: Column, entry: Column, mark: Column, leverage: Column) -> Column:
    """Leveraged return in percent; 0 when flat or without an entry price."""
    gain = F.when(amount > 0, mark - entry).otherwise(entry - mark)
    return F.when((amount == 0) | (entry == 0), F.lit(0.0)).otherwise(leverage * gain / entry * 100)


def shifted(price: Column, percent: Column, leverage: Column, upwards: Column) -> Column:
    """``price`` moved by a percentage of the leveraged margin, not rounded; null without leverage."""
    share = percent / F.lit(100.0) / F.nullif(leverage, F.lit(0))
    return price * F.when(upwards, 1 + share).otherwise(1 - share)


def affordable(balance: Column, leverage: Column, price: Column) -> Column:
    """Quantity the usable share of a balance buys, not rounded; null at a price of 0."""
    return balance * F.lit(BALANCE_SHARE) * leverage / F.nullif(price, F.lit(0.0))


def step_lookup(name: str, levels: Sequence[tuple[float, float]]) -> Column:
    """Result of the largest trigger not above the column ``name``; null below the first.

    The levels are a literal list, so the lookup is a chain of comparisons in generated code, highest first,
    and needs no join.
    """
    steps = [f"WHEN `{name}` >= {float(t)!r}D THEN {float(locked)!r}D" for t, locked in sorted(levels, reverse=True)]
    return F.expr(f"CASE {' '.join(steps)} END")


def ladder(first: float = LADDER_FIRST, last: float = LADDER_LAST, step: float = LADDER_STEP) -> list[float]:
    """Stop-loss percentages to try, in order."""
    return list(itertools.takewhile(lambda percent: percent <= last, itertools.count(first, step)))
