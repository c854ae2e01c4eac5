"""Market-data shapes over the given tables, once as frames and once as SQL.

The frames are what the operators consume; the SQL texts are the same rows for the checks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2024, 1, 30)
MODELS = [("lstm", 7), ("gru", 13), ("xgboost", 29), ("half", 3), ("never", 5)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("asset"),
        F.col("ts").alias("scraped_timestamp"),
        F.to_date("ts").alias("scraped_date"),
        F.col("value").alias("price"),
        F.lit(0).alias("source_id"),
        F.lit(0).alias("engine_id"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Five models per tick; each lacks a value for some users, one is never right, one always rounds up."""
    models = F.array(*[F.struct(F.lit(m).alias("model_type"), F.lit(k).alias("k")) for m, k in MODELS])
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "user_id", F.explode(models).alias("m"))
    value = (
        F.when(F.col("user_id") % 11 == F.col("m.k") % 11, F.lit(None).cast("double"))
        .when(F.col("m.model_type") == "never", 3.0)
        .when(F.col("m.model_type") == "half", 0.5)
        .otherwise((F.col("event_id") * F.col("m.k") % 100).cast("double") / 100)
    )
    return events.select(
        F.col("event_type").alias("asset"),
        F.col("event_id").alias("raw_data_id"),
        F.col("m.model_type").alias("model_type"),
        value.alias("prediction"),
        F.col("ts").alias("predicted_timestamp"),
        F.to_date("ts").alias("predicted_date"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    rounded = F.round("prediction", 0)
    return predictions(spark, folder).filter(rounded.isin(0.0, 1.0)).select(
        "asset",
        F.col("raw_data_id").alias("notice"),
        F.col("model_type").alias("model"),
        F.when(rounded == 0, "sell").otherwise("buy").alias("signal"),
        F.col("model_type").alias("ord"),
    )


def positions(spark: SparkSession, folder: str) -> DataFrame:
    key, entry = F.col("o_orderkey"), F.col("o_totalprice") / 100
    amount = F.when(F.col("o_orderstatus") == "O", 1.5).when(F.col("o_orderstatus") == "F", -2.5).otherwise(0.0)
    return table(spark, folder, "orders").select(
        key.alias("position_id"),
        F.col("o_custkey").alias("symbol"),
        amount.alias("position_amt"),
        entry.alias("entry_price"),
        (entry * (F.lit(1.0) + (key * 37 % 161 - 80).cast("double") / 1000)).alias("mark_price"),
        (1 + key % 20).cast("int").alias("leverage"),
    )


def open_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Three orders per position, at one time; some stops lack a price."""
    key = F.col("o_orderkey")
    legs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("f")) for n, f in [(0, 1.02), (1, 0.99), (2, 1.01)]])
    kind = (
        F.when(F.col("leg.n") == 0, "TAKE_PROFIT_MARKET")
        .when((F.col("leg.n") == 1) & (key % 3 == 0), "STOP")
        .when((F.col("leg.n") == 1) & (key % 3 == 1), "STOP_MARKET")
        .when((F.col("leg.n") == 2) & (key % 2 == 0), "STOP_MARKET")
        .otherwise("LIMIT")
    )
    return table(spark, folder, "orders").withColumn("leg", F.explode(legs)).select(
        (key * 3 + F.col("leg.n")).alias("order_id"),
        key.alias("position_id"),
        kind.alias("type"),
        F.when(key % 5 != 0, F.col("o_totalprice") / 100 * F.col("leg.f")).alias("stop_price"),
        F.col("o_orderdate").alias("order_time"),
    )


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """Successive mark prices of one position per user, opened anew every day on a side by turns, flat from 22:00."""
    return table(spark, folder, "events").select(*mark_columns())


def mark_columns() -> list:
    user, day, is_open = F.col("user_id"), F.dayofmonth("ts"), F.hour("ts") < 22
    amount = F.when((user + day) % 2 == 0, 1.0).otherwise(-1.0)
    return [
        F.col("event_id").alias("mark_id"),
        user.alias("position_id"),
        F.when(is_open, amount).otherwise(0.0).alias("position_amt"),
        F.when(is_open, F.to_date("ts").cast("timestamp_ntz")).alias("opened_at"),
        (40 + day % 3 * 10).cast("double").alias("entry_price"),
        F.col("value").alias("mark_price"),
        (1 + user % 20).cast("int").alias("leverage"),
        F.col("ts").alias("mark_time"),
    ]


def entry_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per order; a third has a direction that is not valid."""
    direction = F.when(F.col("o_orderstatus") == "O", "LONG").when(F.col("o_orderstatus") == "F", "SHORT").otherwise("HOLD")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_custkey").alias("symbol"),
        direction.alias("direction"),
        (F.col("o_totalprice") / 100).alias("price"),
        F.lit(10.0).alias("tp_percent"),
        F.lit(5.0).alias("sl_percent"),
        (1 + F.col("o_custkey") % 20).cast("int").alias("leverage"),
    )


def balances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account"), F.lit("USDT").alias("asset"), F.col("c_acctbal").alias("available_balance")
    )


def income(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(*income_columns())


def income_columns() -> list:
    return [
        F.col("event_id"),
        (F.col("user_id") % 6).alias("symbol"),
        F.when(F.col("event_type") == "purchase", "REALIZED_PNL").otherwise("COMMISSION").alias("income_type"),
        (F.col("value") - 50).alias("income"),
        F.col("ts").alias("income_time"),
    ]


def kv_puts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(*kv_columns())


def kv_columns() -> list:
    return [
        F.col("event_type").alias("asset"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_type"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("weight"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 20).cast("int")).alias("expire_days"),
    ]


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parquet*")


_MODEL_ROWS = ", ".join(f"('{model}', {k})" for model, k in MODELS)

SQL = {
    "ticks": """select event_id as id, event_type as asset, ts as scraped_timestamp, cast(ts as date) as scraped_date,
        value as price, cast(0 as int) as source_id, cast(0 as int) as engine_id from events""",
    "predictions": f"""select e.event_type as asset, e.event_id as raw_data_id, m.model_type,
        case when e.user_id % 11 = m.k % 11 then null when m.model_type = 'never' then cast(3 as double)
             when m.model_type = 'half' then cast(0.5 as double)
             else cast((e.event_id * m.k) % 100 as double) / 100 end as prediction,
        e.ts as predicted_timestamp, cast(e.ts as date) as predicted_date
        from events e cross join (values {_MODEL_ROWS}) as m(model_type, k)""",
    "signals": """select asset, raw_data_id as notice, model_type as model,
        case when round(prediction) = 0 then 'sell' else 'buy' end as signal, model_type as ord
        from predictions where round(prediction) in (0, 1)""",
    "positions": """select o_orderkey as position_id, o_custkey as symbol,
        cast(case o_orderstatus when 'O' then 1.5 when 'F' then -2.5 else 0 end as double) as position_amt,
        o_totalprice / 100 as entry_price,
        o_totalprice / 100 * (cast(1 as double) + cast((o_orderkey * 37) % 161 - 80 as double) / 1000) as mark_price,
        cast(1 + o_orderkey % 20 as int) as leverage from orders""",
    "open_orders": """select o_orderkey * 3 + leg.n as order_id, o_orderkey as position_id,
        case when n = 0 then 'TAKE_PROFIT_MARKET' when n = 1 and o_orderkey % 3 = 0 then 'STOP'
             when n = 1 and o_orderkey % 3 = 1 then 'STOP_MARKET' when n = 2 and o_orderkey % 2 = 0 then 'STOP_MARKET'
             else 'LIMIT' end as type,
        case when o_orderkey % 5 <> 0 then o_totalprice / 100 * leg.f end as stop_price, o_orderdate as order_time
        from orders cross join (values (0, cast(1.02 as double)), (1, cast(0.99 as double)), (2, cast(1.01 as double))) as leg(n, f)""",
    "marks": """select event_id as mark_id, user_id as position_id,
        cast(case when hour(ts) >= 22 then 0 when (user_id + day(ts)) % 2 = 0 then 1 else -1 end as double) as position_amt,
        case when hour(ts) < 22 then cast(cast(ts as date) as timestamp) end as opened_at,
        cast(40 + day(ts) % 3 * 10 as double) as entry_price,
        value as mark_price, cast(1 + user_id % 20 as int) as leverage, ts as mark_time from events""",
    "entry_requests": """select o_orderkey as request_id, o_custkey as account, o_custkey as symbol,
        case o_orderstatus when 'O' then 'LONG' when 'F' then 'SHORT' else 'HOLD' end as direction,
        o_totalprice / 100 as price, cast(10 as double) as tp_percent, cast(5 as double) as sl_percent,
        cast(1 + o_custkey % 20 as int) as leverage from orders""",
    "balances": "select c_custkey as account, 'USDT' as asset, c_acctbal as available_balance from customer",
    "income": """select event_id, user_id % 6 as symbol,
        case when event_type = 'purchase' then 'REALIZED_PNL' else 'COMMISSION' end as income_type,
        value - 50 as income, ts as income_time from events""",
    "kv_puts": """select event_type as asset, concat('m', cast(user_id % 7 as varchar)) as model_type,
        case when event_id % 5 <> 0 then value end as weight, ts as updated_at, event_id as seq,
        case when event_id % 4 <> 0 then cast(event_id % 20 as int) end as expire_days from events""",
}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views, in order, in front. ``body`` may go on with further tables."""
    views = ", ".join(f"{name} as ({SQL[name]})" for name in names.split())
    return f"with {views}{body}" if body.lstrip().startswith(",") else f"with {views} {body}"
