"""Key-value state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import keyed
from tickloom.registry import views
from tickloom.registry.book import query
from tickloom.registry.views import table, with_views
from tickloom.session import scratch_path

KEYS = ["asset", "model_type"]
ORDER = ["updated_at", "seq"]
STATE = """state as (select asset, model_type, weight, updated_at, seq,
    epoch_us(updated_at) // 1000000 + cast(expire_days as bigint) * 86400 as expiration_time from (
    select *, row_number() over (partition by asset, model_type order by updated_at desc, seq desc) as rn from kv_puts) where rn = 1)"""


def _stamped(puts):
    return keyed.stamped(puts, F.col("updated_at"), F.col("expire_days")).drop("expire_days")


def _state(spark, folder):
    return keyed.latest_per_key(_stamped(views.kv_puts(spark, folder)), KEYS, ORDER)


@query("k2_put", with_views("kv_puts", f", {STATE} select * from state"))
def put(spark, folder):
    """State of January's first half, then the rest as a batch."""
    puts = _stamped(views.kv_puts(spark, folder))
    early = F.col("updated_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    state = keyed.latest_per_key(puts.filter(early), KEYS, ORDER)
    return keyed.put(state, puts.filter(~early), KEYS, ORDER)


@query(
    "k1_get",
    with_views("kv_puts", f", {STATE} select * from state where (asset, model_type) in (select (event_type, concat('m', cast(value // 1 % 9 as int))) from events)"),
)
def get(spark, folder):
    wanted = table(spark, folder, "events").select(
        F.col("event_type").alias("asset"), F.concat(F.lit("m"), (F.floor("value") % 9).cast("string")).alias("model_type")
    )
    return keyed.get(_state(spark, folder), wanted, KEYS)


NOW = 1707000000


@query("k3_live_items", with_views("kv_puts", f", {STATE} select * from state where expiration_time is null or expiration_time > {NOW}"))
def live(spark, folder):
    return keyed.live(_state(spark, folder), F.lit(NOW))


@query(
    "k4_delete",
    with_views("kv_puts", f", {STATE} select * from state where (asset, model_type) not in (select (event_type, concat('m', cast(user_id % 7 as varchar))) from events where value > 250)"),
)
def delete(spark, folder):
    doomed = table(spark, folder, "events").filter(F.col("value") > 250).select(*views.kv_columns()[:2])
    return keyed.delete(_state(spark, folder), doomed, KEYS)


@query("k5_full_scan", with_views("kv_puts", " select * from kv_puts"))
def full_scan(spark, folder):
    return views.kv_puts(spark, folder)


@query("u3_scan_of_pages", with_views("kv_puts", " select asset, model_type, weight, seq from kv_puts"))
def scan_of_pages(spark, folder):
    """Items stored page by page come back as one scan."""
    path = scratch_path(spark, "pages")
    puts = views.kv_puts(spark, folder).select("asset", "model_type", "weight", "seq")
    puts.withColumn("page", F.floor(F.col("seq") / 2000)).write.partitionBy("page").parquet(path)
    return spark.read.parquet(path).drop("page")
