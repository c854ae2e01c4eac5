"""Captured price bars into a table, with the rejected ones beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.klines import parse_bars, split_by_health
from tickloom.sources.lake import insert_to_table

BAR_PARTITIONS = ["asset", "bar_date"]


def store_bars(payloads: DataFrame, table: str, quarantine: str, unit: Sequence[str] = ("asset", "scraped_time")) -> None:
    """Replace the (asset, day) partitions of the sound bars in ``table``; append the others to ``quarantine``."""
    good, rejected = split_by_health(parse_bars(payloads), unit)
    dated = good.withColumn("bar_date", F.to_date(F.timestamp_millis("open_time")))
    insert_to_table(dated, table, {}, BAR_PARTITIONS)
    insert_to_table(rejected, quarantine, {}, ["asset"], mode="append")
