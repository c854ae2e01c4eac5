"""The streams, run over everything there is, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import keyed
from tickloom.registry import evaluation, keyvalue, staging, trading, views
from tickloom.registry.book import query
from tickloom.registry.tables import LOADED
from tickloom.registry.views import with_views
from tickloom.session import scratch_path
from tickloom.streaming import changes, jobs, landing, openings

FILES_PER_BATCH = 500


@query("t1_land_files", with_views("ticks", " " + LOADED))
def land_files(spark, folder):
    source, target = staging.landing_folder(spark, folder), scratch_path(spark, "landed")
    stream = jobs.landing_stream(spark, source)
    jobs.land(stream, target, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(target).drop("scraped_date")


_JSON = """'{"timestamp":"' || strftime(scraped_timestamp, '%Y-%m-%d %H:%M:%S') || '","asset":"' || asset || '","price":"'"""


@query(
    "t1_land_files_with_rejects",
    with_views(
        "ticks",
        f""", t as (select *, id // {staging.SHORT_RUN} % 3 as third, id % {staging.SHORT_RUN} as nth,
            {_JSON} || cast(price as varchar) || '","source_id":0,"engine":0}}' as whole from ticks),
        j as (select *, third = 1 and nth = 0 as cut, third = 2 and nth = 1 as odd from t)
        select date_trunc('second', scraped_timestamp) as scraped_timestamp, asset, price, source_id, engine_id,
            cast(null as varchar) as reason, cast(null as varchar) as text from j where not cut and not odd
        union all select null, null, null, null, null, 'no records', left(whole, length(whole) - 10) || chr(10) from j where cut
        union all select null, null, null, null, null, 'value of price', {_JSON} || 'n/a","source_id":"0","engine":"0"}}' from j where odd""",
    ),
)
def land_files_with_rejects(spark, folder):
    """Files that are cut off and records without a price go to the reject table, in several micro-batches; all else lands."""
    source, target = staging.flawed_landing_folder(spark, folder), scratch_path(spark, "landed")
    files = landing.file_stream(spark, source, files_per_batch=FILES_PER_BATCH)
    landing.land_files(files, target, scratch_path(spark, "offsets")).awaitTermination()
    none = F.lit(None).cast("string")
    good = landing.landed(spark, target).withColumns({"reason": none, "text": none})
    return good.unionByName(landing.rejected(spark, target), allowMissingColumns=True).drop("source_file")


@query(
    "s17_file_lifecycle",
    with_views(
        "ticks",
        f""", f as (select distinct id // {staging.SHORT_RUN} % 2 as odd, id // {staging.SHORT_RUN} as run, id % {staging.SHORT_RUN} = 0 as alone from ticks),
        n as (select count(*) filter (odd = 0) as taken, count(*) filter (odd = 1) as pending from f),
        s as (select *, ceil(taken / 3.0) as size from n), b as (select *, cast(ceil(taken / size) as bigint) as batches from s),
        e as (select *, cast(taken - (batches - 1) * size as bigint) as last from b)
        select 'pending' as state, pending as files, cast(0 as bigint) as batches from e where pending > 0
        union all select 'landed', last, 1 from e union all select 'archived', taken - last, batches - 1 from e where batches > 1""",
    ),
)
def file_lifecycle(spark, folder):
    """Half of the files come before the stream runs, in three micro-batches; the others after it."""
    source, archive, target = (scratch_path(spark, name) for name in ("incoming", "archive", "landed"))
    records, odd = staging.tick_records(spark, folder), F.floor(F.col("id") / staging.SHORT_RUN) % 2 == 1
    staging.land_runs(records.filter(~odd), source, staging.SHORT_RUN)
    size = -(-landing.listed(spark, source).count() // 3)
    files = landing.file_stream(spark, source, archive, files_per_batch=size)
    landing.land_files(files, target, scratch_path(spark, "offsets")).awaitTermination()
    staging.land_runs(records.filter(odd), source, staging.SHORT_RUN)
    states = landing.lifecycle(spark, source, archive, target).groupBy("state")
    return states.agg(F.count("*").alias("files"), F.count_distinct("batch").alias("batches"))


def _run(rows, merge):
    spark = rows.sparkSession
    target = scratch_path(spark, "changes")
    changes.write_parts(rows, target, scratch_path(spark, "offsets"), merge).awaitTermination()
    return changes.current(spark, target, merge)


@query("t2_daily_pnl_stream", evaluation.DAILY)
def daily_pnl_stream(spark, folder):
    income = views.streamed(spark, folder, "events").select(*views.income_columns())
    return _run(jobs.pnl_entries(income), jobs.add_up).withColumn("pnl", F.round("pnl", 6))


@query(
    "t3_stop_stream",
    with_views(
        "marks",
        f""", {trading.CANDIDATES}, newest as (select position_id, opened_at, side from (
            select *, row_number() over (partition by position_id order by mark_time desc, mark_id desc) as rn from c)
            where rn = 1 and side is not null)
        select c.position_id, c.side, case when c.side = 'LONG' then max(candidate) else min(candidate) end as stop
        from c join newest n on c.position_id = n.position_id and c.opened_at = n.opened_at and c.side = n.side
        where candidate is not null group by c.position_id, c.side""",
    ),
)
def stop_stream(spark, folder):
    marks = views.streamed(spark, folder, "events").select(*views.mark_columns())
    return jobs.stops_in_force(_run(jobs.scored_marks(marks), jobs.best_stops))


@query(
    "t3_stop_stream_without_openings",
    with_views(
        "marks",
        f""", {trading.CANDIDATES}, turns as (select *, lag(side) over w is distinct from side or row_number() over w = 1 as turn from c
            window w as (partition by position_id order by mark_time, mark_id)),
        runs as (select *, count(*) filter (turn) over (partition by position_id order by mark_time, mark_id rows unbounded preceding) as run from turns),
        ended as (select *, max(run) over (partition by position_id) as open_run from runs)
        select position_id, side, min(mark_time) as opened_at, arg_min(mark_id, (mark_time, mark_id)) as opened_by,
            case when side = 'LONG' then max(candidate) else min(candidate) end as stop
        from ended where run = open_run and side is not null group by position_id, side having count(candidate) > 0""",
    ),
)
def stop_stream_without_openings(spark, folder):
    """The feed does not tell when a position was opened; marks come in four micro-batches."""
    path, target = staging.mark_files(spark, folder), scratch_path(spark, "changes")
    schema = views.marks(spark, folder).drop("opened_at").schema
    marks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    merge = openings.join_stretches
    changes.write_parts(marks, target, scratch_path(spark, "offsets"), merge, openings.stretches).awaitTermination()
    return openings.open_stops(changes.current(spark, target, merge))


@query("t4_latest_item_stream", with_views("kv_puts", f", {keyvalue.STATE} select * from state"))
def latest_item_stream(spark, folder):
    return _run(_streamed_puts(spark, folder), jobs.latest_items(keyvalue.KEYS, keyvalue.ORDER))


@query(
    "t4_live_items_after_compaction",
    with_views("kv_puts", f", {keyvalue.STATE} select * from state where expiration_time is null or expiration_time > {keyvalue.NOW}"),
)
def live_items_after_compaction(spark, folder):
    merge, target = jobs.latest_items(keyvalue.KEYS, keyvalue.ORDER), scratch_path(spark, "changes")
    changes.write_parts(_streamed_puts(spark, folder), target, scratch_path(spark, "offsets"), merge).awaitTermination()
    changes.compact(spark, target, merge, keep=lambda items: keyed.live(items, F.lit(keyvalue.NOW)))
    return changes.current(spark, target, merge)


def _streamed_puts(spark, folder):
    puts = views.streamed(spark, folder, "events").select(*views.kv_columns())
    return keyed.stamped(puts, F.col("updated_at"), F.col("expire_days")).drop("expire_days")
