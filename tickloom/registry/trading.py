"""Positions, stops and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.operators import positions as pos
from tickloom.plans import stop_losses
from tickloom.registry import views
from tickloom.registry.book import query
from tickloom.registry.views import with_views

ROI = """case when position_amt = 0 or entry_price = 0 then cast(0 as double)
    when position_amt > 0 then leverage * (mark_price - entry_price) / entry_price * 100
    else leverage * (entry_price - mark_price) / entry_price * 100 end"""
SIDE = "case when position_amt > 0 then 'LONG' when position_amt < 0 then 'SHORT' end"
LEVELS = ", ".join(f"(cast({trigger} as double), cast({locked} as double))" for trigger, locked in market.TRAILING_LEVELS)


def two(expression: str) -> str:
    return f"cast(printf('%.2f', {expression}) as double)"


def _null_safe_two(expression: str) -> str:
    return f"case when ({expression}) is not null then {two(expression)} end"


STOPS = """first_stops as (select position_id, order_id as stop_order_id, coalesce(stop_price, 0) as current_stop from (
    select *, row_number() over (partition by position_id order by order_time, order_id) as rn
    from open_orders where type in ('STOP_MARKET', 'STOP')) where rn = 1)"""
_SHIFT = "entry_price * (case when side = 'LONG' then 1 + locked / 100 / leverage else 1 - locked / 100 / leverage end)"


@query("x1_roi", with_views("positions", f" select position_id, {ROI} as roi from positions"))
def roi(spark, folder):
    return pos.with_roi(views.positions(spark, folder)).select("position_id", "roi")


@query("x2_side", with_views("positions", f" select position_id, symbol, {SIDE} as side from positions"))
def position_side(spark, folder):
    return pos.with_roi(views.positions(spark, folder)).select("position_id", "symbol", "side")


@query(
    "x3_target_prices",
    with_views(
        "entry_requests",
        f""" select request_id, direction,
        {two("case when direction = 'LONG' then price * (1 + tp_percent / 100 / leverage) else price * (1 - tp_percent / 100 / leverage) end")} as tp_price,
        {two("case when direction = 'LONG' then price * (1 - sl_percent / 100 / leverage) else price * (1 + sl_percent / 100 / leverage) end")} as sl_price
        from entry_requests""",
    ),
)
def target_prices(spark, folder):
    requests = pos.with_targets(views.entry_requests(spark, folder))
    return requests.select("request_id", "direction", "tp_price", "sl_price")


_QUANTITY = "cast(printf('%.6f', available_balance * cast(0.95 as double) * leverage / price) as double)"


@query(
    "x4_order_size",
    with_views(
        "entry_requests balances",
        f""", q as (select request_id, {_QUANTITY} as quantity from entry_requests r join balances b on r.account = b.account)
        select request_id, quantity, floor(quantity * 1000) / 1000 as order_size from q""",
    ),
)
def order_size(spark, folder):
    requests = pos.with_account_balance(views.entry_requests(spark, folder), views.balances(spark, folder))
    sized = pos.with_order_size(requests.filter(F.col("available_balance").isNotNull()))
    return sized.select("request_id", "quantity", "order_size")


@query("j7_positions_without_stop", with_views("positions open_orders", " select * from positions p where not exists (select 1 from open_orders o where o.position_id = p.position_id and o.type = 'STOP_MARKET')"))
def positions_without_stop(spark, folder):
    return pos.without_stop(views.positions(spark, folder), views.open_orders(spark, folder))


@query("j8_first_stop_order", with_views("positions open_orders", f", {STOPS} select p.position_id, p.symbol, s.stop_order_id, s.current_stop from positions p left join first_stops s on p.position_id = s.position_id"))
def first_stop_order(spark, folder):
    stops = pos.first_stop_orders(views.open_orders(spark, folder))
    joined = views.positions(spark, folder).join(stops, "position_id", "left")
    return joined.select("position_id", "symbol", "stop_order_id", "current_stop")


DECIDED = f"""levels(trigger, lock) as (values {LEVELS}), {STOPS},
        r as (select *, {ROI} as roi, {SIDE} as side from positions),
        l as (select r.*, s.stop_order_id, s.current_stop, case when roi > 0 then
            (select max(lock) from levels where trigger <= r.roi) end as locked
            from r left join first_stops s on r.position_id = s.position_id),
        n as (select *, {_null_safe_two(_SHIFT)} as new_stop from l),
        d as (select *, case when position_amt = 0 or entry_price = 0 then 'flat' when roi <= 0 then 'not in profit'
        when locked is null then 'below first level'
        when side = 'LONG' and new_stop < current_stop then 'would reduce'
        when side = 'SHORT' and new_stop > current_stop then 'would reduce'
        when abs(current_stop - new_stop) < 0.0001 then 'within tolerance'
        when stop_order_id is null then 'create' else 'replace' end as decision from n)"""


@query(
    "x5_trailing_stops",
    with_views(
        "positions open_orders",
        f", {DECIDED} select position_id, side, roi, stop_order_id, current_stop, locked, new_stop, decision from d",
    ),
)
def trailing_stops(spark, folder):
    decided = pos.trailing_decisions(views.positions(spark, folder), views.open_orders(spark, folder))
    return decided.select(
        "position_id", "side", "roi", "stop_order_id", "current_stop", "locked", "new_stop", "decision"
    )


@query(
    "x5_trailing_orders",
    with_views(
        "positions open_orders",
        f""", {DECIDED} select position_id, symbol, stop_order_id as cancel_order_id,
        case when position_amt > 0 then 'SELL' else 'BUY' end as order_side, 'STOP_MARKET' as order_type,
        new_stop as stop_price, abs(position_amt) as quantity, true as reduce_only from d where decision in ('create', 'replace')""",
    ),
)
def trailing_orders(spark, folder):
    return stop_losses.trailing_orders(views.positions(spark, folder), views.open_orders(spark, folder))


@query(
    "x6_missing_stops",
    with_views(
        "positions open_orders",
        f""", exposed as (select * from positions p where position_amt <> 0 and not exists
            (select 1 from open_orders o where o.position_id = p.position_id and o.type = 'STOP_MARKET')),
        rungs as (select cast(0.01 as double) + cast(0.5 as double) * n as pct from range(30) t(n)),
        tried as (select e.*, pct, {two("entry_price * (case when position_amt > 0 then 1 - pct / 100 / 20 else 1 + pct / 100 / 20 end)")} as stop_price
            from exposed e cross join rungs),
        firsts as (select position_id, min(pct) as pct, arg_min(stop_price, pct) as stop_price from tried
            where case when position_amt > 0 then stop_price < mark_price else stop_price > mark_price end group by position_id)
        select e.position_id, case when e.position_amt > 0 then 'SELL' else 'BUY' end as order_side,
        abs(e.position_amt) as quantity, round(f.pct, 6) as stop_pct, f.stop_price
        from exposed e left join firsts f on e.position_id = f.position_id""",
    ),
)
def missing_stops(spark, folder):
    stops = pos.missing_stops(views.positions(spark, folder), views.open_orders(spark, folder))
    return stops.withColumn("stop_pct", F.round("stop_pct", 6))


@query(
    "x7_closing_orders",
    with_views("positions", """ select position_id, symbol, case when position_amt > 0 then 'SELL' else 'BUY' end as order_side,
    'MARKET' as order_type, abs(position_amt) as quantity from positions where position_amt <> 0"""),
)
def closing_orders(spark, folder):
    return pos.closing_orders(views.positions(spark, folder))


_VALID = "direction in ('LONG', 'SHORT')"


@query(
    "x8_entry_orders",
    with_views(
        "entry_requests balances",
        f""", q as (select r.*, floor({_QUANTITY} * 1000) / 1000 as quantity, floor(price * 1000) / 1000 as lim
            from entry_requests r left join balances b on r.account = b.account and b.asset = 'USDT' where {_VALID}),
        legs as (select request_id, symbol, 'LIMIT' as order_type, case when direction = 'LONG' then 'BUY' else 'SELL' end as order_side,
            lim as price, false as reduce_only, quantity from q
        union all select request_id, symbol, 'TAKE_PROFIT_MARKET', case when direction = 'LONG' then 'SELL' else 'BUY' end,
            {two("lim * (case when direction = 'LONG' then 1 + tp_percent / 100 / leverage else 1 - tp_percent / 100 / leverage end)")}, true, quantity from q
        union all select request_id, symbol, 'STOP_MARKET', case when direction = 'LONG' then 'SELL' else 'BUY' end,
            {two("lim * (case when direction = 'LONG' then 1 - sl_percent / 100 / leverage else 1 + sl_percent / 100 / leverage end)")}, true, quantity from q)
        select * from legs""",
    ),
)
def entry_orders(spark, folder):
    valid, _ = pos.entry_requests_split(views.entry_requests(spark, folder))
    return pos.entry_orders(pos.with_account_balance(valid, views.balances(spark, folder)))


@query("x8_rejected_requests", with_views("entry_requests", f" select request_id, direction from entry_requests where not {_VALID}"))
def rejected_requests(spark, folder):
    _, rejected = pos.entry_requests_split(views.entry_requests(spark, folder))
    return rejected.select("request_id", "direction")


CANDIDATES = f"""levels(trigger, lock) as (values {LEVELS}),
    r as (select *, {ROI} as roi, {SIDE} as side from marks),
    l as (select r.*, case when roi > 0 then (select max(lock) from levels where trigger <= r.roi) end as locked from r),
    c as (select *, {_null_safe_two(_SHIFT)} as candidate from l)"""


@query(
    "w4_stop_ratchet",
    with_views(
        "marks",
        f""", {CANDIDATES} select mark_id, position_id, side, candidate,
        case when side = 'LONG' then max(candidate) over w else min(candidate) over w end as stop
        from c window w as (partition by position_id, opened_at, side order by mark_time, mark_id rows unbounded preceding)""",
    ),
)
def stop_ratchet(spark, folder):
    return pos.ratchet(views.marks(spark, folder)).select("mark_id", "position_id", "side", "candidate", "stop")
