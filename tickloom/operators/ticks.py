"""Price ticks: latest rows, moves, labels, bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.moments import ordinal
from tickloom.operators.segments import free_name, with_previous

_ORDER = ("scraped_timestamp", "id")


def latest_ticks(ticks: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` ticks of every asset.

    The rank filter becomes a group limit below the shuffle: each task sends at most ``count`` rows per asset.
    """
    rank = free_name(ticks, "rank")
    return ticks.withColumn(rank, F.row_number().over(_newest_first())).filter(F.col(rank) <= count).drop(rank)


def latest_moves(ticks: DataFrame, count: int) -> DataFrame:
    """:func:`latest_ticks` with ``diff``, the price of the next newer tick minus this price.

    The rank filter runs first, in its own window: only then is it a group limit, and the newer tick of a
    kept row is always kept too.
    """
    newer = F.lag("price").over(_newest_first())
    return latest_ticks(ticks, count).withColumn("diff", newer - F.col("price"))


def all_moves(ticks: DataFrame) -> DataFrame:
    """``diff`` for the whole history of every asset, however many ticks an asset has."""
    newer = free_name(ticks, "newer")
    moved = with_previous(ticks, ["asset"], _ORDER, "price", newer, descending=True)
    return moved.withColumn("diff", F.col(newer) - F.col("price")).drop(newer)


def label_moves(moves: DataFrame) -> DataFrame:
    """``true_result``: 1 up, 0 down, null for no move or no newer tick."""
    return moves.withColumn("true_result", F.when(F.col("diff") > 0, 1).when(F.col("diff") < 0, 0))


def bars(ticks: DataFrame, interval: str = "15 minutes") -> DataFrame:
    """Open, high, low, close, volume and trade count per asset and interval, aggregated before the shuffle."""
    moment = ordinal(F.col("scraped_timestamp"), F.col("id"))
    volume = F.col("volume") if "volume" in ticks.columns else F.lit(1.0)
    return (
        ticks.groupBy("asset", F.window("scraped_timestamp", interval).alias("slot"))
        .agg(
            F.min_by("price", moment).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", moment).alias("close"),
            F.sum(volume).alias("volume"),
            F.count(F.lit(1)).alias("number_of_trades"),
        )
        .select(
            "asset",
            F.unix_millis(F.col("slot.start").cast("timestamp")).alias("open_time"),
            (F.unix_millis(F.col("slot.end").cast("timestamp")) - 1).alias("close_time"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            "number_of_trades",
        )
    )


def _newest_first():
    return Window.partitionBy("asset").orderBy(*[F.col(name).desc() for name in _ORDER])
