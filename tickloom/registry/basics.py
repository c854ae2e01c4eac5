"""Casts, filters, scalar functions, limits, set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickloom.functions import documents, market, moments, numbers, text
from tickloom.operators import positions as pos
from tickloom.operators import shaping
from tickloom.registry import views
from tickloom.registry.book import query
from tickloom.registry.views import AS_OF, table, with_views


@query(
    "p1_strict_cast",
    with_views("ticks", " select cast(id as integer) as id, asset, scraped_timestamp, cast(price as float) as price from ticks"),
)
def strict_cast(spark, folder):
    rows = views.ticks(spark, folder).select("id", "asset", "scraped_timestamp", "price")
    return shaping.strict_cast(rows, {"id": "int", "price": "float"})


@query("p2_rename", with_views("ticks", " select id as raw_data_id, asset, price as last_price from ticks"))
def rename(spark, folder):
    rows = views.ticks(spark, folder).select("id", "asset", "price")
    return shaping.rename(rows, {"id": "raw_data_id", "price": "last_price", "absent": "ignored"})


@query("p3_projection", with_views("ticks", " select id, price, asset, price * 2 as doubled, scraped_timestamp from ticks"))
def projection(spark, folder):
    return views.ticks(spark, folder).select(
        "id", "price", "asset", (F.col("price") * 2).alias("doubled"), "scraped_timestamp"
    )


@query("p4_one_asset", with_views("ticks", " select * from ticks where asset = 'purchase'"))
def one_asset(spark, folder):
    return views.ticks(spark, folder).filter(F.col("asset") == "purchase")


@query("p5_look_back", with_views("ticks", f" select * from ticks where scraped_date >= date '{AS_OF}' - 7"))
def look_back(spark, folder):
    return shaping.since(views.ticks(spark, folder), "scraped_date", AS_OF, 7)


LOW, HIGH = datetime(2024, 1, 11), datetime(2024, 1, 12)


@query(
    "p6_open_time_range",
    with_views("ticks", f" select * from ticks where scraped_timestamp > timestamp '{LOW}' and scraped_timestamp < timestamp '{HIGH}'"),
)
def open_time_range(spark, folder):
    return shaping.strictly_between(views.ticks(spark, folder), "scraped_timestamp", LOW, HIGH)


@query("p7_all_conditions", with_views("ticks", " select * from ticks where asset = 'view' and price > 20 and scraped_date < date '2024-01-15'"))
def all_conditions(spark, folder):
    condition = shaping.all_of(["asset = 'view'", F.col("price") > 20, "scraped_date < DATE '2024-01-15'"])
    return views.ticks(spark, folder).filter(condition)


@query("p8_not_null", with_views("predictions", " select * from predictions where prediction is not null"))
def not_null(spark, folder):
    return views.predictions(spark, folder).dropna(subset=["prediction"])


@query(
    "p10_named_parameters",
    with_views("ticks", " select asset, count(1) as n, max(price) as top from ticks where price > 12.5 and asset <> 'error' group by asset"),
)
def named_parameters(spark, folder):
    views.ticks(spark, folder).createOrReplaceTempView("ticks_by_name")
    statement = (
        "SELECT asset, count(1) AS n, max(price) AS top FROM IDENTIFIER(:source)"
        " WHERE price > :floor AND asset <> :skipped GROUP BY asset"
    )
    return spark.sql(statement, args={"source": "ticks_by_name", "floor": 12.5, "skipped": "error"})


@query(
    "p11_statement_list",
    with_views("ticks", " select asset, round(avg(price), 6) as mean_price from ticks where price > 10 group by asset"),
)
def statement_list(spark, folder):
    views.ticks(spark, folder).createOrReplaceTempView("ticks_listed")
    return shaping.run_statements(
        spark,
        [
            ("CREATE OR REPLACE TEMP VIEW ticks_above AS SELECT asset, price FROM ticks_listed WHERE price > 10", {}),
            ("SELECT asset, round(avg(price), :places) AS mean_price FROM ticks_above GROUP BY asset", {"places": 6}),
        ],
    )


@query(
    "p12_constant_columns",
    with_views("ticks", " select id, price, timestamp '2024-01-31 00:00:00' as scraped_time, 'USDT' as quote from ticks"),
)
def constant_columns(spark, folder):
    return shaping.stamp(views.ticks(spark, folder).select("id", "price"), scraped_time=datetime(2024, 1, 31), quote="USDT").withColumn(
        "scraped_time", F.col("scraped_time").cast("timestamp_ntz")
    )


@query("p13_balance_of_account", with_views("balances", " select available_balance from balances where account = 7 and asset = 'USDT'"))
def balance_of_account(spark, folder):
    held = views.balances(spark, folder)
    return held.filter((F.col("account") == 7) & (F.col("asset") == "USDT")).select("available_balance")


@query(
    "p13_balance_of_many",
    with_views("entry_requests balances", " select r.*, b.available_balance from entry_requests r left join balances b on r.account = b.account and b.asset = 'USDT'"),
)
def balance_of_many(spark, folder):
    return pos.with_account_balance(views.entry_requests(spark, folder), views.balances(spark, folder))


@query(
    "p13_leverage_of_symbol",
    with_views(
        "entry_requests positions",
        """ select r.* exclude (leverage), k.leverage from entry_requests r
        left join (select symbol, min(leverage) as leverage from positions group by symbol) k on r.symbol = k.symbol""",
    ),
)
def leverage_of_symbol(spark, folder):
    return pos.with_symbol_leverage(views.entry_requests(spark, folder).drop("leverage"), views.positions(spark, folder))


@query(
    "f2_nearest_large",
    """select l_orderkey, l_linenumber, l_extendedprice * 40000 + l_discount / 7 as value,
    cast(printf('%.6f', l_extendedprice * 40000 + l_discount / 7) as double) as six,
    cast(printf('%.7f', l_extendedprice * 40000 + l_discount / 7) as double) as seven from lineitem""",
)
def nearest_large(spark, folder):
    value = F.col("l_extendedprice") * 40000 + F.col("l_discount") / 7
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))
    return numbers.with_nearest(numbers.with_nearest(rows, {"six": F.col("value")}, 6), {"seven": F.col("value")}, 7)


@query("f1_round", with_views("predictions", " select raw_data_id, model_type, round(prediction) as rounded, cast(round(prediction) as integer) as as_int from predictions"))
def rounding(spark, folder):
    rounded = numbers.whole(F.col("prediction"))
    return views.predictions(spark, folder).select(
        "raw_data_id", "model_type", rounded.alias("rounded"), rounded.cast("int").alias("as_int")
    )


@query(
    "f2_nearest",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount,
    cast(printf('%.2f', l_extendedprice * l_discount / 3) as double) as two,
    cast(printf('%.6f', l_extendedprice * l_discount / 7) as double) as six,
    cast(printf('%.2f', round(l_extendedprice) / 8) as double) as ties from lineitem""",
)
def nearest(spark, folder):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"
    )
    rows = numbers.with_nearest(rows, {"two": price * discount / 3, "ties": F.round(price, 0) / 8}, 2)
    return numbers.with_nearest(rows, {"six": price * discount / 7}, 6)


@query("f3_floor_to", "select l_orderkey, l_linenumber, l_extendedprice, floor(l_extendedprice / 7 * 1000) / 1000 as cut from lineitem")
def floor_to(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", numbers.floor_to(F.col("l_extendedprice") / 7, 3).alias("cut")
    )


@query(
    "f4_arithmetic",
    with_views("positions", " select position_id, abs(position_amt) as size, abs(mark_price - entry_price) < 100 as near, position_amt * entry_price as notional from positions"),
)
def arithmetic(spark, folder):
    amount, entry = F.col("position_amt"), F.col("entry_price")
    return views.positions(spark, folder).select(
        "position_id",
        F.abs(amount).alias("size"),
        (F.abs(F.col("mark_price") - entry) < 100).alias("near"),
        (amount * entry).alias("notional"),
    )


@query("f5_date_offset", with_views("ticks", " select id, scraped_date - 1 as day_before, scraped_date - 30 as month_before from ticks"))
def date_offset(spark, folder):
    day = F.col("scraped_date")
    return views.ticks(spark, folder).select(
        "id",
        moments.look_back_start(day, 1).alias("day_before"),
        moments.look_back_start(day, 30).alias("month_before"),
    )


@query("f6_zone", with_views("ticks", " select id, scraped_timestamp, scraped_timestamp + interval 7 hour as bangkok_time from ticks"))
def zone(spark, folder):
    """The zone has been seven hours ahead of UTC, without changes, since 1920."""
    moment = F.col("scraped_timestamp")
    return views.ticks(spark, folder).select("id", moment, moments.in_zone(moment, "Asia/Bangkok").alias("bangkok_time"))


@query(
    "f7_epochs",
    with_views(
        "ticks",
        """ select id, epoch_us(scraped_timestamp) // 1000 as millis, date_trunc('day', scraped_timestamp) as midnight,
        make_timestamp(epoch_us(scraped_timestamp) // 1000 * 1000) as back from ticks""",
    ),
)
def epochs(spark, folder):
    moment = F.col("scraped_timestamp")
    millis = moments.to_millis(moment)
    return views.ticks(spark, folder).select(
        "id",
        millis.alias("millis"),
        moments.utc_day(moment).cast("timestamp_ntz").alias("midnight"),
        moments.from_millis(millis).cast("timestamp_ntz").alias("back"),
    )


@query(
    "f8_time_texts",
    with_views("ticks", " select id, strftime(scraped_timestamp, '%Y-%m-%d %H:%M:%S') as record_text, strftime(scraped_timestamp, '%Y%m%d_%H%M%S') as file_text from ticks"),
)
def time_texts(spark, folder):
    moment = F.col("scraped_timestamp")
    return views.ticks(spark, folder).select(
        "id", moments.record_text(moment).alias("record_text"), moments.file_text(moment).alias("file_text")
    )


@query(
    "f9_json",
    """select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_extract_string(props, '$.k') as k_text,
    '{"asset":"' || event_type || '","k":' || cast(json_extract(props, '$.k') as bigint) || '}' as printed from events""",
)
def json_values(spark, folder):
    parsed = F.from_json("props", "k bigint")["k"]
    return table(spark, folder, "events").select(
        "event_id",
        parsed.alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"),
        F.to_json(F.struct(F.col("event_type").alias("asset"), parsed.alias("k"))).alias("printed"),
    )


def _exact(expression: str) -> str:
    return f"cast(cast(cast({expression} as varchar) as decimal(38, 18)) as varchar)"


@query(
    "f10_exact_decimals",
    f"""select event_id, event_type, {_exact('value')} as weight, {_exact('value / 4')} as first_part,
    {_exact('value + 0.1')} as nested_weight, cast(event_id as bigint) as nested_id from events""",
)
def exact_decimals(spark, folder):
    value = F.col("value")
    items = table(spark, folder, "events").select(
        "event_id",
        F.struct(
            F.col("event_type").alias("name"),
            value.alias("weight"),
            F.array(value / 4, value).alias("parts"),
            F.create_map(F.lit("inner"), F.struct(F.col("event_id").alias("id"), (value + 0.1).alias("weight"))).alias("nested"),
        ).alias("item"),
    )
    exact = items.withColumn("item", documents.exact_decimals(F.col("item"), items.schema["item"].dataType))
    inner = F.col("item.nested")["inner"]
    return exact.select(
        "event_id",
        F.col("item.name").alias("event_type"),
        F.col("item.weight").cast("string").alias("weight"),
        F.col("item.parts")[0].cast("string").alias("first_part"),
        inner["weight"].cast("string").alias("nested_weight"),
        inner["id"].alias("nested_id"),
    )


@query(
    "f11_type_fingerprints",
    """select names, count(1) as records from (select
    'str,' || case when event_type = 'purchase' then 'str' else 'float' end || ','
    || case when event_id % 3 = 0 then 'NoneType' else 'int' end || ',dict' as names from events) group by names""",
)
def type_fingerprints(spark, folder):
    value = F.col("value").cast("string")
    price = F.when(F.col("event_type") == "purchase", F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    seq = F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.col("event_id").cast("string"))
    document = F.format_string('{"asset":"%s","price":%s,"seq":%s,"props":%s}', F.col("event_type"), price, seq, F.col("props"))
    names = F.array_join(documents.json_type_names(document, ["asset", "price", "seq", "props"]), ",")
    return table(spark, folder, "events").groupBy(names.alias("names")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "f12_texts",
    """select page_id, regexp_extract(url, '[^/]*$') as base,
    case when starts_with(url, 'http://') then 'https://' || substr(url, 8) else url end as moved,
    replace(url, 'e', '<E>') as replaced, concat('page ', cast(page_id as varchar)) as label from pages""",
)
def texts(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        text.base_name(url).alias("base"),
        text.with_prefix(url, "http://", "https://").alias("moved"),
        F.replace(url, F.lit("e"), F.lit("<E>")).alias("replaced"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("label"),
    )


@query("f13_units", "select doc_id, n_chars / (1024 * 1024) as mb, n_chars / 1000 as s from documents")
def units(spark, folder):
    size = F.col("n_chars")
    return table(spark, folder, "documents").select(
        "doc_id", numbers.megabytes(size).alias("mb"), numbers.seconds(size).alias("s")
    )


@query(
    "l1_newest_of_one_asset",
    with_views("ticks", """ select id, asset, scraped_timestamp, price, scraped_timestamp + interval 7 hour as bangkok_time
    from ticks where asset = 'purchase' order by id desc limit 2000"""),
)
def newest_of_one_asset(spark, folder):
    bought = views.ticks(spark, folder).filter(F.col("asset") == "purchase")
    zoned = bought.select(
        "id", "asset", "scraped_timestamp", "price",
        moments.in_zone(F.col("scraped_timestamp"), "Asia/Bangkok").alias("bangkok_time"),
    )
    return shaping.latest_rows(zoned, ["id"], 2000)


@query(
    "l2_latest_rows_then_filter",
    with_views("ticks", " select * from (select id, asset, scraped_timestamp, price from ticks order by scraped_timestamp desc, id desc limit 15) where price > 10"),
)
def latest_rows_then_filter(spark, folder):
    rows = views.ticks(spark, folder).select("id", "asset", "scraped_timestamp", "price")
    return shaping.latest_rows(rows, ["scraped_timestamp", "id"], 15).filter(F.col("price") > 10)


@query("l3_preview", with_views("ticks", " select id, asset, price from ticks order by id limit 10"))
def preview(spark, folder):
    return views.ticks(spark, folder).select("id", "asset", "price").orderBy("id").limit(10)


@query("u1_concatenate", with_views("ticks", " select id, asset, price, cast(asset = 'view' as int) as flag from ticks"))
def concatenate(spark, folder):
    rows = views.ticks(spark, folder).select("id", "asset", "price")
    viewed = F.col("asset") == "view"
    frames = [
        rows.filter(viewed).withColumn("flag", F.lit(1)),
        rows.filter(~viewed).withColumn("flag", F.lit(0)).select("flag", "price", "asset", "id"),
    ]
    first, *others = frames
    for frame in others:
        first = first.unionByName(frame)
    return first


@query("u2_distinct_partitions", with_views("ticks", " select distinct asset, scraped_date from ticks"))
def distinct_partitions(spark, folder):
    return views.ticks(spark, folder).select("asset", "scraped_date").distinct()


@query(
    "j6_step_lookup",
    with_views(
        "positions",
        f""", levels(trigger, locked) as (values {", ".join(f"(cast({a} as double), cast({b} as double))" for a, b in market.TRAILING_LEVELS)}),
        r as (select position_id, case when position_amt = 0 or entry_price = 0 then 0 when position_amt > 0
        then leverage * (mark_price - entry_price) / entry_price * 100
        else leverage * (entry_price - mark_price) / entry_price * 100 end as roi from positions)
        select position_id, (select max(l.locked) from levels l where l.trigger <= r.roi) as locked from r""",
    ),
)
def step_lookup(spark, folder):
    rows = pos.with_roi(views.positions(spark, folder))
    return rows.select("position_id", market.step_lookup("roi", market.TRAILING_LEVELS).alias("locked"))
