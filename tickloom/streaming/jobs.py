"""The streams: landing files, daily profit, trailing stops, latest items.

Each of the last three is a frame of rows to combine and the merge that combines them, for
:func:`tickloom.streaming.changes.write_parts` and :func:`~tickloom.streaming.changes.current`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.keyed import latest_per_key
from tickloom.operators.pnl import REALIZED
from tickloom.operators.positions import stop_candidates, towards_profit
from tickloom.sources.landing import TICK_SCHEMA, typed_ticks
from tickloom.streaming.changes import Merge


def landing_stream(spark: SparkSession, folder: str, archive: str | None = None, schema: str = TICK_SCHEMA) -> DataFrame:
    """Tick records of a landing folder, each file once.

    The checkpoint remembers processed files. A file that does not parse fails the batch, as in a batch read, so that it
    neither counts as processed nor lands as empty rows. With ``archive`` a file moves there when a later batch commits.
    """
    reader = spark.readStream.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return typed_ticks(reader.json(folder))


def land(ticks: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ticks to a folder partitioned by date; the file sink commits every batch exactly once."""
    dated = ticks.withColumn("scraped_date", F.to_date("scraped_timestamp"))
    return (
        dated.writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("scraped_date")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def pnl_entries(income: DataFrame) -> DataFrame:
    """One row per realised income, for :func:`add_up`. Late income counts as any other."""
    day = F.to_date("income_time").alias("day")
    realized = income.filter(F.col("income_type") == REALIZED)
    return realized.select(day, "symbol", F.col("income").alias("pnl"), F.lit(1).cast("long").alias("entries"))


def add_up(parts: DataFrame) -> DataFrame:
    """Realised profit per UTC day and symbol; the merge of the profit stream."""
    pnl = F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl")
    return parts.groupBy("day", "symbol").agg(pnl, F.sum("entries").alias("entries"))


def scored_marks(marks: DataFrame) -> DataFrame:
    """Marks with the stop each alone would ask for, for :func:`best_stops`. ``opened_at`` as in ``positions.ratchet``."""
    score = F.struct("opened_at", towards_profit(F.col("candidate"), F.col("side")).alias("score"))
    newest = F.struct("mark_time", "mark_id", "opened_at", "side").alias("newest")
    return stop_candidates(marks).select("position_id", newest, F.when(F.col("candidate").isNotNull(), score).alias("best"))


def best_stops(parts: DataFrame) -> DataFrame:
    """Newest mark and best stop of the newest opening per position; the merge of the stop stream, whatever the order of arrival."""
    return parts.groupBy("position_id").agg(F.max("newest").alias("newest"), F.max("best").alias("best"))


def stops_in_force(best: DataFrame) -> DataFrame:
    """Trailing stops of the positions that are open and have reached one. A stop of an earlier opening is not in force."""
    side = F.col("newest.side")
    same = side.isNotNull() & F.col("best").isNotNull() & F.col("best.opened_at").eqNullSafe(F.col("newest.opened_at"))
    return best.filter(same).select("position_id", side.alias("side"), towards_profit(F.col("best.score"), side).alias("stop"))


def latest_items(keys: Sequence[str], order: Sequence[str]) -> Merge:
    """Newest item per key, whole items as in :func:`tickloom.operators.keyed.latest_per_key`; the merge of the item stream.

    To let items expire, read through :func:`tickloom.operators.keyed.live` and compact with it. A key that was compacted
    away starts anew with its next put.
    """
    return partial(latest_per_key, keys=keys, order=order)
