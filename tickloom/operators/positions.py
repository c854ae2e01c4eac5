"""Returns, order plans and stops over whole position tables.

A position has ``position_id, symbol, position_amt, entry_price, mark_price, leverage``; an open order has
``order_id, position_id, type, stop_price, order_time``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.functions.moments import ordinal
from tickloom.functions.numbers import floor_to, with_nearest
from tickloom.operators.segments import Buckets, free_name, with_running_max

# Below every ordinal: an order without a time is the oldest.
_BEFORE_ALL_TIMES = Decimal(-(10**37))


def with_roi(positions: DataFrame) -> DataFrame:
    """Side and leveraged return of every position."""
    value = market.roi(F.col("position_amt"), F.col("entry_price"), F.col("mark_price"), F.col("leverage"))
    return positions.withColumns({"side": market.side(F.col("position_amt")), "roi": value})


def first_stop_orders(orders: DataFrame, types: Sequence[str] = ("STOP_MARKET", "STOP")) -> DataFrame:
    """Oldest open stop order of each position, combined before the shuffle in hash aggregation. Order ids are numbers."""
    number = F.col("order_id").cast("decimal(19,0)")
    age = F.coalesce(ordinal(F.col("order_time"), F.col("order_id")), F.lit(_BEFORE_ALL_TIMES) + number)
    price = F.coalesce("stop_price", F.lit(0.0))
    first = [F.min_by("order_id", age).alias("stop_order_id"), F.min_by(price, age).alias("current_stop")]
    return orders.filter(F.col("type").isin(*types)).groupBy("position_id").agg(*first)


def without_stop(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Positions that have no ``STOP_MARKET`` order."""
    stops = orders.filter(F.col("type") == "STOP_MARKET").select("position_id").distinct()
    return positions.join(stops, "position_id", "left_anti")


def trailing_decisions(
    positions: DataFrame, orders: DataFrame, levels: list[tuple[float, float]] = market.TRAILING_LEVELS
) -> DataFrame:
    """New trailing stop of every position and what to do about it.

    Decisions, first match wins: ``flat``, ``not in profit``, ``below first level``, ``would reduce``,
    ``within tolerance``, ``create`` (no stop yet), ``replace``.
    """
    is_long = F.col("side") == "LONG"
    wanted = stop_candidates(positions, levels).withColumnRenamed("candidate", "new_stop")
    steps = wanted.join(first_stop_orders(orders), "position_id", "left")
    new, current = F.col("new_stop"), F.col("current_stop")
    reduces = F.when(is_long, new < current).otherwise(new > current)
    decision = (
        F.when(F.col("side").isNull() | (F.col("entry_price") == 0), "flat")
        .when(F.col("roi") <= 0, "not in profit")
        .when(F.col("locked").isNull(), "below first level")
        .when(reduces, "would reduce")
        .when(F.abs(current - new) < market.STOP_TOLERANCE, "within tolerance")
        .when(F.col("stop_order_id").isNull(), "create")
        .otherwise("replace")
    )
    return steps.withColumn("decision", decision)


def missing_stops(
    positions: DataFrame,
    orders: DataFrame,
    first: float = market.LADDER_FIRST,
    last: float = market.LADDER_LAST,
    step: float = market.LADDER_STEP,
    leverage: float = market.LADDER_LEVERAGE,
) -> DataFrame:
    """Stop for each open position without one: the first rung the mark price has not crossed.

    Rungs move away from the entry price, so the last crossed one is found by halving, five price comparisons
    for thirty rungs. The last price tried that is not crossed is the stop. ``stop_pct`` and ``stop_price`` are null where even the last
    rung is crossed.
    """
    rungs = market.ladder(first, last, step)
    if not rungs:
        raise ValueError("the ladder has no rung")
    percents = F.expr("array(" + ", ".join(f"{percent!r}D" for percent in rungs) + ")")
    amount, passed, tried = F.col("position_amt"), F.col("passed"), F.col("tried")

    def price(rung: Column) -> dict[str, Column]:
        percent = F.get(percents, rung)
        return {"tried": market.shifted(F.col("entry_price"), percent, F.lit(float(leverage)), amount < 0)}

    exposed = without_stop(positions.filter(amount != 0), orders)
    start = {"passed": F.lit(-1), "sign": F.signum(amount), "stop_price": F.lit(None).cast("double")}
    searched = exposed.withColumns(start)
    crossed = F.coalesce((F.col("mark_price") - tried) * F.col("sign") <= 0, tried.isNotNull())
    stride = 1 << (len(rungs).bit_length() - 1)
    while stride:
        searched = with_nearest(searched, price(passed + stride), market.PRICE_PLACES)
        step = {
            "passed": F.when(crossed, passed + stride).otherwise(passed),
            "stop_price": F.when(crossed | tried.isNull(), F.col("stop_price")).otherwise(tried),
        }
        searched = searched.withColumns(step)
        stride >>= 1
    return searched.select(
        "position_id",
        market.closing_side(amount).alias("order_side"),
        F.abs(amount).alias("quantity"),
        F.get(percents, passed + 1).alias("stop_pct"),
        "stop_price",
    )


def closing_orders(positions: DataFrame) -> DataFrame:
    """Market order that closes each open position."""
    amount = F.col("position_amt")
    return positions.filter(amount != 0).select(
        "position_id",
        "symbol",
        market.closing_side(amount).alias("order_side"),
        F.lit("MARKET").alias("order_type"),
        F.abs(amount).alias("quantity"),
    )


def entry_requests_split(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a valid direction and, where they have such columns, a price and a leverage; the rejected others."""
    valid = F.col("direction").isin("LONG", "SHORT")
    for name in {"price", "leverage"} & set(requests.columns):
        valid &= F.col(name) > 0
    valid = F.coalesce(valid, F.lit(False))
    return requests.filter(valid), requests.filter(~valid)


def with_order_size(requests: DataFrame) -> DataFrame:
    """Add ``quantity``, the most the usable share of the balance buys, and ``order_size``, cut to order decimals."""
    quantity = market.affordable(F.col("available_balance"), F.col("leverage"), F.col("price"))
    sized = with_nearest(requests, {"quantity": quantity}, market.QUANTITY_PLACES)
    return sized.withColumn("order_size", floor_to(F.col("quantity"), market.ORDER_PLACES))


def with_targets(requests: DataFrame, price: str = "price") -> DataFrame:
    """Add take-profit and stop-loss prices around the column ``price``."""
    base, leverage, is_long = F.col(price), F.col("leverage"), F.col("direction") == "LONG"
    targets = {
        "tp_price": market.shifted(base, F.col("tp_percent"), leverage, is_long),
        "sl_price": market.shifted(base, F.col("sl_percent"), leverage, ~is_long),
    }
    return with_nearest(requests, targets, market.PRICE_PLACES)


def entry_orders(requests: DataFrame) -> DataFrame:
    """Entry, take-profit and stop-loss order for every request of :func:`entry_requests_split`.

    A request has ``request_id, symbol, direction, available_balance, price, tp_percent, sl_percent, leverage``.
    """
    is_long = F.col("direction") == "LONG"
    entry_side = F.when(is_long, "BUY").otherwise("SELL")
    exit_side = F.when(is_long, "SELL").otherwise("BUY")
    limit_price = floor_to(F.col("price"), market.ORDER_PLACES)
    priced = with_targets(with_order_size(requests).withColumn("limit_price", limit_price), "limit_price")
    legs = F.array(
        _leg("LIMIT", entry_side, F.col("limit_price"), False),
        _leg("TAKE_PROFIT_MARKET", exit_side, F.col("tp_price"), True),
        _leg("STOP_MARKET", exit_side, F.col("sl_price"), True),
    )
    exploded = priced.select("request_id", "symbol", F.col("order_size").alias("quantity"), F.explode(legs).alias("leg"))
    return exploded.select("request_id", "symbol", "leg.*", "quantity")


def _leg(kind: str, order_side: Column, price: Column, reduce_only: bool) -> Column:
    return F.struct(
        F.lit(kind).alias("order_type"),
        order_side.alias("order_side"),
        price.alias("price"),
        F.lit(reduce_only).alias("reduce_only"),
    )


def stop_candidates(marks: DataFrame, levels: list[tuple[float, float]] = market.TRAILING_LEVELS) -> DataFrame:
    """Trailing stop that each mark of a position alone would ask for; null below the first level.

    To keep only rows that ask for one, filter on ``locked``: a filter on ``candidate`` would be pushed below
    the formula and evaluate it twice.
    """
    steps = with_roi(marks)
    steps = steps.withColumn("locked", F.when(F.col("roi") > 0, market.step_lookup("roi", levels)))
    stop = market.shifted(F.col("entry_price"), F.col("locked"), F.col("leverage"), F.col("side") == "LONG")
    return with_nearest(steps, {"candidate": stop}, market.PRICE_PLACES)


def towards_profit(price: Column, position_side: Column) -> Column:
    """Price with the sign that makes a better stop larger: shorts count down. Its own inverse."""
    return F.when(position_side == "LONG", price).otherwise(-price)


def with_opening(marks: DataFrame) -> DataFrame:
    """Add ``opened_at``, the time and id of the mark that opened the position anew; null while it is flat.

    For feeds that do not say when a position was opened: the first mark opens, and so does each whose side differs from the one
    before, which a flat mark does too.
    """
    order = ["mark_time", "mark_id"]
    side, before, opening = (free_name(marks, label) for label in ("side", "previous_side", "opening"))
    buckets = Buckets(marks, ["position_id"], order)
    sided = buckets.placed(marks).withColumn(side, market.side(F.col("position_amt")))
    turned = buckets.previous(sided, side, before)
    opens = F.col(side).isNotNull() & ~F.col(side).eqNullSafe(F.col(before))
    openings = turned.withColumn(opening, F.when(opens, F.struct(*order)))
    history = buckets.running(openings, {"opened_at": ("max", opening)})
    opened = F.when(F.col(side).isNotNull(), F.col("opened_at"))
    return buckets.plain(history.withColumn("opened_at", opened).drop(before, opening, side))


def ratchet(marks: DataFrame) -> DataFrame:
    """Stop in force after each mark: it only ever moves in the direction of profit, and ends with the position.

    ``opened_at`` tells a position from an earlier one under the same id; its values grow (:func:`with_opening` finds them).
    Flat marks have no stop.
    """
    signed = stop_candidates(marks)
    score, best = free_name(signed, "score"), free_name(signed, "best")
    signed = signed.withColumn(score, towards_profit(F.col("candidate"), F.col("side")))
    history = with_running_max(signed, ["position_id", "opened_at", "side"], ["mark_time", "mark_id"], score, best)
    return history.withColumn("stop", towards_profit(F.col(best), F.col("side"))).drop(score, best)


def with_account_balance(requests: DataFrame, balances: DataFrame, asset: str = "USDT") -> DataFrame:
    """Add the account's available balance of ``asset``; of several rows the smallest, so no request multiplies."""
    owned = balances.filter(F.col("asset") == asset).groupBy("account").agg(F.min("available_balance").alias("available_balance"))
    return requests.join(owned, "account", "left")


def with_symbol_leverage(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """Add the leverage set for the request's symbol; of several positions the smallest, null without one."""
    known = positions.groupBy("symbol").agg(F.min("leverage").alias("leverage"))
    return requests.join(known, "symbol", "left")
