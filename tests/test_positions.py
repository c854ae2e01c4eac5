"""Position rules against plain Python, one position at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.operators import positions as pos

POSITION = "position_id int, symbol string, position_amt double, entry_price double, mark_price double, leverage int"
ORDER = "order_id int, position_id int, type string, stop_price double, order_time int"


def expected_decision(position, stops):
    _, _, amount, entry, mark, leverage = position
    if amount == 0 or entry == 0:
        return "flat", None
    sign = 1 if amount > 0 else -1
    roi = leverage * ((mark - entry) if sign > 0 else (entry - mark)) / entry * 100
    if roi <= 0:
        return "not in profit", None
    reached = [locked for trigger, locked in market.TRAILING_LEVELS if trigger <= roi]
    if not reached:
        return "below first level", None
    new = round(entry * (1 + sign * (max(reached) / 100 / leverage)), 2)
    if not stops:
        return "create", new
    current = min(stops, key=lambda o: (o[4], o[0]))[3] or 0.0
    if (new - current) * sign < 0:
        return "would reduce", new
    return ("within tolerance" if abs(current - new) < 0.0001 else "replace"), new


def test_trailing_decisions(spark):
    source = random.Random(11)
    positions, orders = [], []
    for i in range(3000):
        entry = source.choice([0.0, 10.0, 123.45, 50000.0, source.uniform(1, 1000)])
        amount = source.choice([0.0, 1.5, -2.0])
        leverage = source.randint(1, 20)
        mark = entry * (1 + source.uniform(-0.1, 0.4) * (1 if amount >= 0 else -1))
        positions.append((i, "s", amount, entry, mark, leverage))
        exact = expected_decision(positions[-1], [])[1]
        for _ in range(source.randint(0, 3)):
            price = source.choice([None, entry, exact, mark])
            kind = source.choice(["STOP", "STOP_MARKET", "LIMIT"])
            orders.append((len(orders), i, kind, price, source.randint(0, 1)))
    result = pos.trailing_decisions(spark.createDataFrame(positions, POSITION), spark.createDataFrame(orders, ORDER))
    actual = {r["position_id"]: (r["decision"], r["new_stop"]) for r in result.collect()}
    seen = set()
    for position in positions:
        stops = [o for o in orders if o[1] == position[0] and o[2] in ("STOP", "STOP_MARKET")]
        expected = expected_decision(position, stops)
        assert actual[position[0]][0] == expected[0], position
        if expected[1] is not None:
            assert actual[position[0]][1] == expected[1], position
        seen.add(expected[0])
    assert len(actual) == len(positions) and len(seen) == 7


def test_a_filter_on_the_decision_is_allowed(spark):
    positions = spark.createDataFrame([(1, "s", 1.0, 100.0, 200.0, 10)], POSITION)
    result = pos.trailing_decisions(positions, spark.createDataFrame([], ORDER)).filter("decision = 'create'")
    assert result.first()["new_stop"] == round(100 * (1 + 85 / 100 / 10), 2)


def test_missing_stops(spark):
    source = random.Random(5)
    positions = []
    for i in range(2000):
        entry = source.choice([1.0, 12.5, 900.0, 60000.0])
        positions.append((i, "s", source.choice([0.0, 2.0, -3.0]), entry, entry * source.uniform(0.985, 1.015), 7))
    orders = [(i, i, "STOP_MARKET" if i % 3 else "STOP", 1.0, 0) for i in range(0, 2000, 2)]
    result = pos.missing_stops(spark.createDataFrame(positions, POSITION), spark.createDataFrame(orders, ORDER))
    actual = {r["position_id"]: r for r in result.collect()}
    protected = {o[1] for o in orders if o[2] == "STOP_MARKET"}
    exposed = [p for p in positions if p[2] != 0 and p[0] not in protected]
    assert set(actual) == {p[0] for p in exposed}
    outcomes = set()
    for number, _, amount, entry, mark, _ in exposed:
        percent, found = 0.01, None
        while percent <= 15 and found is None:
            share = (percent / 100) / 20
            price = round(entry * (1 - share if amount > 0 else 1 + share), 2)
            if price < mark if amount > 0 else price > mark:
                found = (percent, price)
            percent += 0.5
        row = actual[number]
        assert (row["stop_pct"], row["stop_price"]) == (found or (None, None))
        assert row["order_side"] == ("SELL" if amount > 0 else "BUY") and row["quantity"] == abs(amount)
        outcomes.add(found is None)
    assert outcomes == {True, False}


def test_roi_counts_leverage_and_flips_for_shorts(spark):
    rows = [(1, "s", 1.0, 100.0, 110.0, 5), (2, "s", -1.0, 100.0, 110.0, 5), (3, "s", 0.0, 100.0, 110.0, 5), (4, "s", 1.0, 0.0, 9.0, 5)]
    result = {r["position_id"]: r for r in pos.with_roi(spark.createDataFrame(rows, POSITION)).collect()}
    assert [result[i]["roi"] for i in (1, 2, 3, 4)] == [50.0, -50.0, 0.0, 0.0]
    assert [result[i]["side"] for i in (1, 2, 3, 4)] == ["LONG", "SHORT", None, "LONG"]


@pytest.mark.parametrize("direction,signs", [("LONG", (1, -1)), ("SHORT", (-1, 1))])
def test_entry_orders(spark, direction, signs):
    request = spark.createDataFrame(
        [(1, "s", direction, 1000.0, 43210.98765, 10.0, 5.0, 8)],
        "request_id int, symbol string, direction string, available_balance double, price double,"
        " tp_percent double, sl_percent double, leverage int",
    )
    legs = {r["order_type"]: r for r in pos.entry_orders(request).collect()}
    limit = 43210.987
    assert legs["LIMIT"]["price"] == limit and not legs["LIMIT"]["reduce_only"]
    assert legs["TAKE_PROFIT_MARKET"]["price"] == round(limit * (1 + signs[0] * (10 / 100) / 8), 2)
    assert legs["STOP_MARKET"]["price"] == round(limit * (1 + signs[1] * (5 / 100) / 8), 2)
    assert legs["LIMIT"]["quantity"] == int(round(1000 * 0.95 * 8 / 43210.98765, 6) * 1000) / 1000
    sides = (legs["LIMIT"]["order_side"], legs["STOP_MARKET"]["order_side"])
    assert sides == (("BUY", "SELL") if direction == "LONG" else ("SELL", "BUY"))


def test_invalid_directions_are_kept_apart(spark):
    requests = spark.createDataFrame([(1, "LONG"), (2, "HOLD"), (3, None)], "request_id int, direction string")
    valid, rejected = pos.entry_requests_split(requests)
    assert [r[0] for r in valid.collect()] == [1] and [r[0] for r in rejected.collect()] == [2, 3]


def test_closing_orders(spark):
    rows = [(1, "s", 1.5, 1.0, 1.0, 1), (2, "s", -2.5, 1.0, 1.0, 1), (3, "s", 0.0, 1.0, 1.0, 1)]
    orders = pos.closing_orders(spark.createDataFrame(rows, POSITION)).collect()
    assert [(r["position_id"], r["order_side"], r["quantity"]) for r in orders] == [(1, "SELL", 1.5), (2, "BUY", 2.5)]


def test_ratchet_never_goes_back(spark, small_buckets):
    marks = spark.range(2000).select(
        F.col("id").alias("mark_id"),
        (F.col("id") % 2).alias("position_id"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("position_amt"),
        F.lit(0).alias("opened_at"),
        F.lit(100.0).alias("entry_price"),
        (100 + 30 * F.sin(F.col("id") / 50)).alias("mark_price"),
        F.lit(5).alias("leverage"),
        (F.col("id") / 10).cast("int").alias("mark_time"),
    )
    rows = sorted(pos.ratchet(marks).collect(), key=lambda r: r["mark_id"])
    for side, sign in (("LONG", 1), ("SHORT", -1)):
        best = None
        for row in (r for r in rows if r["side"] == side):
            if row["candidate"] is not None and (best is None or sign * row["candidate"] > sign * best):
                best = row["candidate"]
            assert row["stop"] == best
    assert len(rows) == 2000


MARK = "mark_id long, position_id long, position_amt double, entry_price double, mark_price double, leverage int, mark_time int"


def test_a_stop_ends_with_its_position(spark):
    rows = [(1, 1, 1.0, 100.0, 110.0, 5, 1), (2, 1, 0.0, 0.0, 110.0, 5, 2), (3, 1, 1.0, 50.0, 50.5, 5, 3), (4, 1, -1.0, 50.0, 45.0, 5, 4)]
    marks = pos.with_opening(spark.createDataFrame(rows, MARK))
    found = {r.mark_id: (r.opened_at and tuple(r.opened_at), r.stop) for r in pos.ratchet(marks).collect()}
    assert found[1][0] == (1, 1) and found[1][1] > 100
    assert found[2] == (None, None)
    assert found[3][0] == (3, 3) and 50 < found[3][1] < 50.5
    assert found[4][0] == (4, 4) and found[4][1] < 50


def test_openings_equal_a_walk_over_each_position(spark, small_buckets):
    source = random.Random(5)
    rows = [(i, 0 if source.random() < 0.8 else source.randint(1, 5), source.choice([1.0, 1.0, 1.0, -1.0, 0.0]), 1.0, 1.0, 1, i // 3)
            for i in range(3000)]
    expected, held = {}, {}
    for i, position, amount, *_, time in rows:
        side, opened = held.get(position, (0.0, None))
        if amount != side:
            opened = (time, i) if amount else None
        held[position] = (amount, opened)
        expected[i] = opened
    found = pos.with_opening(spark.createDataFrame(rows, MARK).repartition(8)).collect()
    assert {r.mark_id: r.opened_at and tuple(r.opened_at) for r in found} == expected


def test_oldest_stop_order_is_found_by_hash_aggregation(spark):
    rows = [(3, 1, "STOP", 9.0, None), (2, 1, "STOP", 8.0, 0), (5, 2, "STOP", None, 7), (4, 2, "STOP_MARKET", 6.0, 7), (1, 2, "LIMIT", 1.0, 1)]
    first = pos.first_stop_orders(spark.createDataFrame(rows, ORDER))
    assert {tuple(r) for r in first.collect()} == {(1, 3, 9.0), (2, 4, 6.0)}
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()


def test_requests_without_price_or_leverage_are_rejected_and_stop_nothing(spark):
    rows = [(1, "LONG", 100.0, 10, 50.0), (2, "LONG", 0.0, 10, 50.0), (3, "SHORT", 100.0, 0, 50.0), (4, "SHORT", None, 5, 50.0)]
    requests = spark.createDataFrame(rows, "request_id int, direction string, price double, leverage int, available_balance double")
    valid, rejected = pos.entry_requests_split(requests)
    assert [r.request_id for r in valid.collect()] == [1] and sorted(r.request_id for r in rejected.collect()) == [2, 3, 4]
    sizes = {r.request_id: r.order_size for r in pos.with_order_size(requests).collect()}
    assert sizes[1] == 4.75 and sizes[2] is None


def test_several_balances_and_positions_do_not_multiply_requests(spark):
    requests = spark.createDataFrame([(1, 7, 3), (2, 8, 4)], "request_id int, account int, symbol int")
    balances = spark.createDataFrame([(7, "USDT", 5.0), (7, "USDT", 9.0), (7, "BTC", 1.0)], "account int, asset string, available_balance double")
    positions = spark.createDataFrame([(3, 20), (3, 10)], "symbol int, leverage int")
    owned = {r.request_id: r.available_balance for r in pos.with_account_balance(requests, balances).collect()}
    assert owned == {1: 5.0, 2: None}
    assert {r.request_id: r.leverage for r in pos.with_symbol_leverage(requests, positions).collect()} == {1: 10, 2: None}
