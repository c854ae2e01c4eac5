"""Stop-loss maintenance of all positions as one batch. The result is a table; nothing is sent anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.operators.positions import missing_stops, trailing_decisions


def trailing_orders(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Stop order to place, and open order to cancel first, for every position whose trailing stop moves."""
    decided = trailing_decisions(positions, orders)
    amount = F.col("position_amt")
    return decided.filter(F.col("decision").isin("create", "replace")).select(
        "position_id",
        "symbol",
        F.col("stop_order_id").alias("cancel_order_id"),
        market.closing_side(amount).alias("order_side"),
        F.lit("STOP_MARKET").alias("order_type"),
        F.col("new_stop").alias("stop_price"),
        F.abs(amount).alias("quantity"),
        F.lit(True).alias("reduce_only"),
    )


def protective_orders(positions: DataFrame, orders: DataFrame, **ladder: float) -> tuple[DataFrame, DataFrame]:
    """Stop order to place for every position without one, and the open positions past the last rung, which get none."""
    found = missing_stops(positions, orders, **ladder)
    placed = found.filter(F.col("stop_price").isNotNull())
    order = placed.select("position_id", "order_side", F.lit("STOP_MARKET").alias("order_type"), "stop_price", "quantity")
    return order, found.filter(F.col("stop_price").isNull()).select("position_id", "order_side", "quantity")
