"""Sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.text import base_name
from tickloom.operators.shaping import guarded_select
from tickloom.plans import captures, model_weights
from tickloom.registry import evaluation, staging, views
from tickloom.registry.book import query
from tickloom.registry.views import AS_OF, with_views
from tickloom.session import broadcast_if_small, scratch_path, written
from tickloom.sources import klines, lake, landing, relational

LANDED = """select strftime(scraped_timestamp, '%Y-%m-%d %H:%M:%S') as "timestamp", asset, cast(price as varchar) as price,
    source_id, engine_id as engine from ticks"""
LOADED = "select date_trunc('second', scraped_timestamp) as scraped_timestamp, asset, price, source_id, engine_id from ticks"
BARS = """h as (select asset, epoch_ms(slot) as open_time, epoch_ms(slot) + 3599999 as close_time, cast(slot as date) as scraped_time,
    arg_min(price, id) as open, max(price) as high, min(price) as low, arg_max(price, id) as close,
    cast(count(1) as double) as volume, count(1) as number_of_trades
    from (select *, time_bucket(interval 1 hour, scraped_timestamp) as slot from ticks) group by asset, slot),
    typed as (select open_time, open, high, low, close, volume, close_time, volume * close as quote_asset_volume, number_of_trades,
    volume / 2 as taker_buy_base_asset_volume, volume * close / 2 as taker_buy_quote_asset_volume, '0' as "ignore", scraped_time, asset from h)"""
_BROKEN = "(asset = 'error' and scraped_time = date '2024-01-05') or (asset = 'signup' and scraped_time = date '2024-01-10')"
_SOUND = f"asset not in (select asset from typed where {_BROKEN})"


@query("s1_read_json_folder", with_views("ticks", " " + LANDED))
def read_json_folder(spark, folder):
    return landing.read_records(spark, staging.landing_folder(spark, folder))


@query("s2_load_json_folder", with_views("ticks", " " + LOADED))
def load_json_folder(spark, folder):
    name = staging.new_table(spark, "staged_ticks")
    landing.load_folder(spark, staging.landing_folder(spark, folder), name)
    return spark.table(name)


@query("s3_normalise_klines", with_views("ticks", f", {BARS} select * from typed where {_SOUND}"))
def normalise_klines(spark, folder):
    return klines.typed_bars(staging.kline_payloads(spark, folder))


@query("s3_captured_files", with_views("ticks", f", {BARS} select * from typed where {_SOUND}"))
def captured_files(spark, folder):
    """The bars of captured files, named by asset and time; the bars of a file with another name are left out."""
    bars = klines.typed_bars(klines.read_captures(spark, staging.captured_files(spark, folder)))
    return bars.withColumn("scraped_time", F.col("scraped_time").cast("date"))


_STRAY = "asset = 'click' and scraped_time = (select min(scraped_time) from typed where asset = 'click')"


@query(
    "s4_quarantined_files",
    with_views(
        "ticks",
        f""", {BARS} select asset, scraped_time, count(1) as bars from typed where not ({_SOUND}) group by all
        union all select 'stray', null, count(1) from typed where {_STRAY} having count(1) > 0""",
    ),
)
def quarantined_files(spark, folder):
    """Of captured files: the assets with a flawed bar, and the stray file, whose own name Spark chose."""
    captured = klines.read_captures(spark, staging.captured_files(spark, folder))
    _, rejected = klines.split_by_health(klines.parse_bars(captured))
    asset = F.when(F.col("scraped_time").isNull(), "stray").otherwise(F.col("asset")).alias("asset")
    return rejected.groupBy(asset, F.to_date("scraped_time").alias("scraped_time")).agg(F.count(F.lit(1)).alias("bars"))


@query("s4_sound_captures", with_views("ticks", f", {BARS} select * from typed where not ({_BROKEN})"))
def sound_captures(spark, folder):
    return klines.typed_bars(staging.kline_payloads(spark, folder), unit=("asset", "scraped_time"))


@query("s4_quarantined_assets", with_views("ticks", f", {BARS} select asset, scraped_time, count(1) as bars from typed where not ({_SOUND}) group by all"))
def quarantined_assets(spark, folder):
    _, rejected = klines.split_by_health(klines.parse_bars(staging.kline_payloads(spark, folder)))
    return rejected.groupBy("asset", "scraped_time").agg(F.count(F.lit(1)).alias("bars"))


@query(
    "s4_stored_captures",
    with_views(
        "ticks",
        f""", {BARS} select asset, cast(scraped_time as date) as day, count(1) as bars, sum(case when {_BROKEN} then 1 else 0 end) > 0 as quarantined
        from typed group by all""",
    ),
)
def stored_captures(spark, folder):
    sound, rejected = staging.new_table(spark, "bars"), staging.new_table(spark, "rejected")
    captures.store_bars(staging.kline_payloads(spark, folder), sound, rejected)
    columns = ["asset", F.col("scraped_time").alias("day")]
    good = spark.table(sound).select(*columns, F.lit(False).alias("quarantined"))
    bad = spark.table(rejected).select(*columns, F.lit(True).alias("quarantined"))
    return good.unionByName(bad).groupBy("asset", "day", "quarantined").agg(F.count(F.lit(1)).alias("bars"))


@query("s5_ticker_records", with_views("ticks", " " + LANDED))
def ticker_records(spark, folder):
    payload = F.to_json(F.struct(F.col("asset").alias("symbol"), F.col("price").cast("string").alias("price")))
    captured = views.ticks(spark, folder).select(payload.alias("payload"), "scraped_timestamp")
    return landing.ticker_records(captured, F.col("scraped_timestamp"))


@query("s6_relational_read", with_views("ticks", " select id, asset, scraped_timestamp, price from ticks where price > 20"))
def relational_read(spark, folder):
    url, name = staging.jdbc_tick_table(spark, folder)
    rows = relational.read_table(spark, url, name, "id", 8, {"preferTimestampNTZ": "true"})
    lowered = rows.toDF(*[column.lower() for column in rows.columns])
    return lowered.filter(F.col("price") > 20).select("id", "asset", "scraped_timestamp", "price")


@query("s6_last_of_statements", with_views("ticks", " select asset, count(1) as n, max(price) as top from ticks where asset <> 'view' group by asset"))
def last_of_statements(spark, folder):
    url, name = staging.jdbc_tick_table(spark, folder)
    result = relational.select_last(
        spark,
        url,
        [
            f"DELETE FROM {name} WHERE asset = 'view'",
            f"SELECT asset, count(*) AS n, max(price) AS top FROM {name} GROUP BY asset",
        ],
    )
    return result.toDF("asset", "n", "top").withColumn("n", F.col("n").cast("bigint"))


@query("s7_relational_append", with_views("ticks", " select id, asset, scraped_timestamp, price from ticks"))
def relational_append(spark, folder):
    url, name = staging.jdbc_tick_table(spark, folder)
    rows = relational.read_table(spark, url, name, "id", 8, {"preferTimestampNTZ": "true"})
    return rows.toDF(*[column.lower() for column in rows.columns])


@query("s8_relational_replace", with_views("ticks", " select id, asset, scraped_timestamp, price + 1 as price from ticks where asset = 'click'"))
def relational_replace(spark, folder):
    url, name = staging.jdbc_tick_table(spark, folder)
    new = views.ticks(spark, folder).filter(F.col("asset") == "click").select(
        "id", "asset", "scraped_timestamp", (F.col("price") + 1).alias("price")
    )
    relational.replace_all_rows(new, url, name)
    rows = relational.read_table(spark, url, name, "id", 8, {"preferTimestampNTZ": "true"})
    return rows.toDF(*[column.lower() for column in rows.columns])


@query(
    "s10_relational_delete_insert",
    with_views("ticks", """ select id, asset, scraped_timestamp, case when asset = 'click' and price > 30 then price + 1 else price end as price
    from ticks where not (asset = 'view' and price > 30)"""),
)
def relational_delete_insert(spark, folder):
    url, name = staging.jdbc_tick_table(spark, folder)
    new = views.ticks(spark, folder).filter("asset = 'click' and price > 30").select(
        "id", "asset", "scraped_timestamp", (F.col("price") + 1).alias("price")
    )
    relational.delete_rows(spark, url, name, ["asset = 'view'", "price > 30"])
    relational.delete_insert_rows(new, url, name, ["asset = 'click'", "price > 30"])
    rows = relational.read_table(spark, url, name, "id", 8, {"preferTimestampNTZ": "true"})
    return rows.toDF(*[column.lower() for column in rows.columns])


@query("s9_conditional_delete", with_views("kv_puts", " select seq, asset, weight from kv_puts where not coalesce(asset <> 'view' and weight > 20, false)"))
def conditional_delete(spark, folder):
    """Rows without a weight stay, as the condition is unknown for them."""
    name = staging.new_table(spark, "puts")
    lake.insert_to_table(views.kv_puts(spark, folder).select("seq", "asset", "weight"), name, {}, ["asset"])
    lake.delete_rows(spark, name, ["asset <> 'view'", "weight > 20"])
    return spark.table(name)


@query("s9_delete_whole_partitions", with_views("ticks", " select * from ticks where not (asset = 'view' and scraped_date < date '2024-01-20')"))
def delete_whole_partitions(spark, folder):
    name = staging.tick_table(spark, folder)
    lake.delete_rows(spark, name, ["asset = 'view'", "scraped_date < DATE '2024-01-20'"])
    return spark.table(name)


@query(
    "s10_delete_insert",
    with_views(
        "ticks",
        """ select id, scraped_timestamp, case when scraped_date = date '2024-01-12' then price * 2 else price end as price, source_id,
        case when scraped_date = date '2024-01-12' then 9 else engine_id end as engine_id, asset, scraped_date
        from ticks where scraped_date <> date '2024-01-11'""",
    ),
)
def delete_insert(spark, folder):
    """Two days go, one of them comes back changed; the emptied partitions of the other are gone."""
    name = staging.tick_table(spark, folder)
    day = views.ticks(spark, folder).filter("scraped_date = DATE '2024-01-12'")
    new = day.withColumns({"price": F.col("price") * 2, "engine_id": F.lit(9)})
    lake.delete_insert(new, name, ["scraped_date >= DATE '2024-01-11'", "scraped_date <= DATE '2024-01-12'"])
    return spark.table(name)


_CHANGED = "case when scraped_date >= date '2024-01-25' then price + 1 else price end"


@query("s11_overwrite_partitions", with_views("ticks", f" select id, asset, scraped_date, {_CHANGED} as price from ticks"))
def overwrite_partitions(spark, folder):
    name = staging.tick_table(spark, folder)
    late = views.ticks(spark, folder).filter("scraped_date >= DATE '2024-01-25'")
    lake.insert_to_table(
        late.withColumn("price", F.col("price") + 1), name, {"price": "double"}, ["asset", "scraped_date"]
    )
    return spark.table(name).select("id", "asset", "scraped_date", "price")


@query(
    "s11_append",
    with_views("ticks", " select id, asset, scraped_date, price from ticks union all select id, asset, scraped_date, -price from ticks where asset = 'click'"),
)
def append(spark, folder):
    name = staging.tick_table(spark, folder)
    more = views.ticks(spark, folder).filter("asset = 'click'").withColumn("price", -F.col("price"))
    lake.insert_to_table(more, name, {"price": "double"}, ["asset", "scraped_date"], mode="append")
    return spark.table(name).select("id", "asset", "scraped_date", "price")


@query("s11_overwrite", with_views("ticks", " select id, asset, scraped_date, price from ticks where asset = 'click'"))
def overwrite(spark, folder):
    name = staging.tick_table(spark, folder)
    only = views.ticks(spark, folder).filter("asset = 'click'")
    lake.insert_to_table(only, name, {"id": "bigint"}, ["asset", "scraped_date"], mode="overwrite")
    return spark.table(name).select("id", "asset", "scraped_date", "price")


@query(
    "s11_stored_weights",
    evaluation._weights_sql(
        evaluation.RECENT,
        "rn <= 15",
        """select asset, model_type, cast(total_predicted as int) as total_predicted,
        cast(corrected_prediction as int) as corrected_prediction, round(cast(cast(accuracy as float) as double), 5) as accuracy,
        round(cast(cast(accuracy / sum(accuracy) over (partition by asset) as float) as double), 5) as weight from accuracy""",
    ),
)
def stored_weights(spark, folder):
    """The whole job: score the recent ticks, store the weights by asset, read them back."""
    name = staging.new_table(spark, "weights")
    recent = model_weights.recent_weights(views.ticks(spark, folder), views.predictions(spark, folder), AS_OF, 1, 15)
    model_weights.store_weights(recent, name)
    stored = spark.table(name)
    return stored.withColumns({c: F.round(F.col(c).cast("double"), 5) for c in ("accuracy", "weight")})


@query("s12_guarded_select", with_views("ticks", " select asset, scraped_date, count(1) as n from ticks where price > 10 group by all"))
def guarded(spark, folder):
    views.ticks(spark, folder).createOrReplaceTempView("ticks_guarded")
    text = (
        "SELECT asset, scraped_date, count(1) AS n FROM ticks_guarded WHERE price > :floor"
        " GROUP BY asset, scraped_date"
    )
    return guarded_select(spark, text, limit=100_000, args={"floor": 10.0})


WEIGHTS_STATEMENT = """
    WITH recent AS (
        SELECT id, asset, price, scraped_timestamp FROM IDENTIFIER(:ticks)
        WHERE asset = :asset AND scraped_date >= date_sub(:as_of, :days)
        ORDER BY scraped_timestamp DESC, id DESC LIMIT :count),
    moves AS (
        SELECT id, asset, sign(lag(price) OVER (ORDER BY scraped_timestamp DESC, id DESC) - price) AS direction FROM recent),
    scores AS (
        SELECT model_type, asset, count(1) AS total_predicted,
            count_if(round(prediction) = if(direction > 0, 1, 0)) AS corrected_prediction
        FROM moves JOIN (SELECT raw_data_id AS id, model_type, prediction FROM IDENTIFIER(:predictions)
            WHERE asset = :asset AND predicted_date >= date_sub(:as_of, :days)) USING (id)
        WHERE direction <> 0 AND prediction IS NOT NULL GROUP BY ALL HAVING corrected_prediction > 0)
    SELECT model_type, asset, corrected_prediction, total_predicted, round(corrected_prediction / total_predicted, 9) AS accuracy,
        round(corrected_prediction / total_predicted / sum(corrected_prediction / total_predicted) OVER (PARTITION BY asset), 9) AS weight
    FROM scores"""


@query("s12_weights_by_statement", evaluation._weights_sql(evaluation.RECENT, "rn <= 15 and asset = 'purchase'"))
def weights_by_statement(spark, folder):
    """The weights of one asset as a parameterised statement."""
    views.ticks(spark, folder).createOrReplaceTempView("ticks_scored")
    views.predictions(spark, folder).createOrReplaceTempView("predictions_scored")
    values = {"ticks": "ticks_scored", "predictions": "predictions_scored", "asset": "purchase", "as_of": AS_OF, "days": 1, "count": 15}
    return guarded_select(spark, WEIGHTS_STATEMENT, limit=1000, args=values)


@query("s13_delete_all", with_views("ticks", " select (select count(1) from ticks) as rows_before, cast(0 as bigint) as rows_after, 7 as columns_after"))
def delete_all(spark, folder):
    name = staging.tick_table(spark, folder)
    before = written(spark.table(name).agg(F.count(F.lit(1)).alias("rows_before")), "count")
    lake.delete_all(spark, name)
    after = spark.table(name).agg(F.count(F.lit(1)).alias("rows_after"))
    both = before.unionByName(after, allowMissingColumns=True)
    return both.agg(
        F.max("rows_before").alias("rows_before"),
        F.max("rows_after").alias("rows_after"),
        F.max(F.lit(len(spark.table(name).columns))).alias("columns_after"),
    )


_DAILY_SQL = "select asset, scraped_date, count(1) as n, round(sum(price), 6) as total from ticks group by asset, scraped_date"


def _daily_query(source: str) -> str:
    return (
        "SELECT asset, scraped_date, count(1) AS n, round(sum(price), 6) AS total"
        f" FROM {source} GROUP BY asset, scraped_date"
    )


@query("s14_aggregate_to_table", with_views("ticks", f" {_DAILY_SQL}"))
def aggregate_to_table(spark, folder):
    """Run twice: the second run replaces the first."""
    views.ticks(spark, folder).createOrReplaceTempView("ticks_aggregated")
    name = staging.new_table(spark, "daily")
    for mode in ("append", "delete_insert"):
        lake.aggregate_to_table(spark, _daily_query("ticks_aggregated"), name, mode=mode)
    return spark.table(name)


@query("m1_run_statistics", with_views("ticks", f", d as ({_DAILY_SQL}) select count(1) as written, true as took_time, true as read_files from d"))
def run_statistics(spark, folder):
    ticks = views.ticks(spark, folder)
    ticks.createOrReplaceTempView("ticks_measured")
    name = staging.new_table(spark, "measured")
    stats = lake.aggregate_to_table(
        spark, _daily_query("ticks_measured"), name, sources=[views.table(spark, folder, "events")]
    )
    return spark.table(name).agg(
        F.max(F.lit(stats.rows)).cast("bigint").alias("written"),
        F.max(F.lit(stats.runtime_s > 0)).alias("took_time"),
        F.max(F.lit(stats.scanned_mb > 0)).alias("read_files"),
    )


@query("s15_csv_export", with_views("ticks", f", {BARS} select * from typed where {_SOUND}"))
def csv_export(spark, folder):
    bars = klines.typed_bars(staging.kline_payloads(spark, folder))
    path = scratch_path(spark, "csv")
    klines.export_csv(bars, path)
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(bars.schema).csv(path)


@query("s16_json_export", with_views("ticks", " " + LANDED))
def json_export(spark, folder):
    path = scratch_path(spark, "json")
    landing.export_records(staging.tick_records(spark, folder).drop("id"), path)
    return spark.read.schema(landing.TICK_SCHEMA).json(path).drop("by_asset")


@query("s17_landed_files", "select cast(sum(n) as bigint) as files, cast(sum(records) as bigint) as records from (select (case when count(1) filter (event_id % 5000 = 0) > 0 then 1 else 0 end + case when count(1) filter (event_id % 5000 <> 0) > 0 then 1 else 0 end) as n, count(1) as records from events group by event_id // 5000)")
def landed_files(spark, folder):
    """What a landing folder holds: files by base name, and records."""
    path = staging.landing_folder(spark, folder)
    files = landing.read_records(spark, path).select(base_name(F.col("_metadata.file_path")).alias("file"))
    per_file = files.groupBy("file").agg(F.count(F.lit(1)).alias("records"))
    return per_file.agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"))


@query("a6_partition_tuples", with_views("ticks", " select asset, scraped_date, count(1) as n from ticks group by all"))
def partition_tuples(spark, folder):
    name = staging.tick_table(spark, folder)
    return spark.table(name).groupBy("asset", "scraped_date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j5_rows_of_partitions",
    with_views("ticks", " select id, asset, scraped_date, price from ticks where (asset, scraped_date) in (select (asset, scraped_date) from ticks where price > 200)"),
)
def rows_of_partitions(spark, folder):
    ticks = views.ticks(spark, folder).select("id", "asset", "scraped_date", "price")
    tuples = written(ticks.filter(F.col("price") > 200).select("asset", "scraped_date").distinct(), "tuples")
    side = broadcast_if_small(tuples, lake.MAX_BROADCAST_PARTITIONS)
    return ticks.join(side, ["asset", "scraped_date"], "left_semi")
