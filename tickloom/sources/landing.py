"""JSON tick files: one record, or a list of records, per file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.moments import record_text
from tickloom.operators.shaping import rename, strict_cast
from tickloom.sources import lake

# The record layout, its defaults, and the names and types of the loaded table.
TICK_SCHEMA = "timestamp string, asset string, price string, source_id int, engine int"
DEFAULT_SOURCE_ID = 0
DEFAULT_ENGINE = 0
TICK_NAMES = {"timestamp": "scraped_timestamp", "source": "source_id", "engine": "engine_id"}
TICK_TYPES = {"scraped_timestamp": "timestamp_ntz", "price": "double"}


def read_records(spark: SparkSession, folder: str, schema: str = TICK_SCHEMA) -> DataFrame:
    """All records of a folder; files with one object and files with a list may be mixed."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(folder)


def typed_ticks(records: DataFrame, names: Mapping[str, str] = TICK_NAMES) -> DataFrame:
    """Tick records with table names and types."""
    return strict_cast(rename(records, names), TICK_TYPES)


def load_folder(
    spark: SparkSession,
    folder: str,
    table: str,
    names: Mapping[str, str] = TICK_NAMES,
    schema: str = TICK_SCHEMA,
    partitions: Sequence[str] = (),
) -> None:
    """Append every file of a folder to a table in one job; the table is created when it does not exist."""
    rows = typed_ticks(read_records(spark, folder, schema), names)
    lake.insert_to_table(rows, table, {}, partitions, mode="append")


def ticker_records(payloads: DataFrame, scraped_at: Column) -> DataFrame:
    """Records in the landing layout from captured ticker payloads (``payload``: JSON with symbol and price)."""
    ticker = F.from_json("payload", "symbol string, price string")
    return payloads.select(
        record_text(scraped_at).alias("timestamp"),
        ticker["symbol"].alias("asset"),
        ticker["price"].alias("price"),
        F.lit(DEFAULT_SOURCE_ID).alias("source_id"),
        F.lit(DEFAULT_ENGINE).alias("engine"),
    )


def export_records(records: DataFrame, folder: str) -> None:
    """Write records as JSON, one folder per asset; Spark sizes the files. The record keeps its ``asset``."""
    records.withColumn("by_asset", F.col("asset")).write.partitionBy("by_asset").json(folder)
