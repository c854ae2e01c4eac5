"""Captured price-bar payloads: JSON lists of positional lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.moments import FILE_FORMAT
from tickloom.functions.text import base_name
from tickloom.operators.shaping import all_of
from tickloom.session import broadcast_if_small, written

# Names and types of the positions of a bar.
BAR_TYPES = {
    "open_time": "bigint",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "volume": "double",
    "close_time": "bigint",
    "quote_asset_volume": "double",
    "number_of_trades": "bigint",
    "taker_buy_base_asset_volume": "double",
    "taker_buy_quote_asset_volume": "double",
    "ignore": "string",
}
# Failed units joined by broadcast; a unit is a few dozen bytes.
MAX_BROADCAST_UNITS = 200_000
_CAPTURE = "capture"
_FILE_NAME = r"^(.+)_(\d{8}_\d{6})\.json$"
_INTEGERS = ("bigint", "int", "smallint", "tinyint")


def write_captures(payloads: DataFrame, folder: str) -> None:
    """Write captured payloads as files, each in a folder ``capture={asset}_{yyyyMMdd_HHmmss}.json``.

    Spark names its files itself, so the folder carries the name. Every payload is a file of its own.
    """
    name = F.concat("asset", F.lit("_"), F.date_format("scraped_time", FILE_FORMAT), F.lit(".json"))
    named = payloads.select(F.col("payload").alias("value"), name.alias(_CAPTURE))
    named.write.mode("append").option("maxRecordsPerFile", 1).partitionBy(_CAPTURE).text(folder)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captured payload files named ``{asset}_{yyyyMMdd_HHmmss}.json``: asset, scrape time and whole text of each.

    Files of :func:`write_captures` have the name of their folder. A file with another name has its name as asset and no
    scrape time, which makes its bars bad.
    """
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    captured = F.regexp_extract(path, f"/{_CAPTURE}=([^/]+)/[^/]*$", 1)
    # A partition folder escapes its value, and the path the folder.
    unescaped = F.url_decode(F.replace(captured, F.lit("+"), F.lit("%2B")))
    name = F.when(captured != "", unescaped).otherwise(base_name(path))
    time = F.try_to_timestamp(F.regexp_extract(name, _FILE_NAME, 2), F.lit(FILE_FORMAT)).cast("timestamp_ntz")
    asset = F.when(time.isNotNull(), F.regexp_extract(name, _FILE_NAME, 1)).otherwise(name)
    return spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(
        asset.alias("asset"), time.alias("scraped_time"), F.col("value").alias("payload")
    )


def parse_bars(payloads: DataFrame, types: Mapping[str, str] = BAR_TYPES) -> DataFrame:
    """One row per bar with ``bad`` telling whether it does not fit ``types``.

    ``payloads`` has ``asset``, ``scraped_time`` and ``payload``. Text that is not a list of lists, a bar of
    the wrong length, a value that does not cast, a null in an integer column and every bar without an asset or a
    scrape time are bad. A bad payload without any readable bar gives one bad row, so that it is seen.
    """
    parsed = payloads.withColumn("bars", F.from_json("payload", "array<array<string>>"))
    readable = F.col("bars").isNotNull()
    bar = F.explode_outer("bars").alias("bar")
    rows = parsed.select("asset", "scraped_time", readable.alias("readable"), (F.size("bars") > 0).alias("filled"), bar)
    unnamed = F.col("asset").isNull() | F.col("scraped_time").isNull()
    rows = rows.filter(~F.col("readable") | F.col("filled") | unnamed)
    values = {name: F.get("bar", i).try_cast(kind) for i, (name, kind) in enumerate(types.items())}
    flawed = [_flawed(F.get("bar", i), kind) for i, kind in enumerate(types.values())]
    bad = ~F.col("readable") | F.col("bar").isNull() | (F.size("bar") != len(types)) | F.greatest(*flawed) | unnamed
    return rows.select(
        *[value.alias(name) for name, value in values.items()], "scraped_time", "asset", F.coalesce(bad, F.lit(True)).alias("bad")
    )


def _flawed(raw: Column, kind: str) -> Column:
    lost = raw.isNotNull() & raw.try_cast(kind).isNull()
    return lost | raw.isNull() if kind in _INTEGERS else lost


def split_by_health(bars: DataFrame, unit: Sequence[str] = ("asset",)) -> tuple[DataFrame, DataFrame]:
    """Bars of the units without any bad bar, and the quarantined bars of all other units, good ones included.

    With ``unit=("asset",)`` one bad bar rejects the asset; with ``("asset", "scraped_time")`` it rejects the
    one capture it came with. The bars are written once, so that the payloads are parsed once for the list of
    failed units and both results. A list that is not small is joined by shuffle, where the adaptive skew join
    splits a hot asset.
    """
    bars = written(bars, "bars")
    failed = broadcast_if_small(written(bars.filter("bad").select(*unit).distinct(), "failed"), MAX_BROADCAST_UNITS)
    columns = [name for name in bars.columns if name != "bad"]
    same = all_of([bars[name].eqNullSafe(failed[name]) for name in unit])
    good = bars.join(failed, same, "left_anti").select(*columns)
    quarantined = bars.join(failed, same, "left_semi").select(*columns)
    return good, quarantined


def typed_bars(payloads: DataFrame, unit: Sequence[str] = ("asset",), types: Mapping[str, str] = BAR_TYPES) -> DataFrame:
    """Bars of every asset whose capture is sound, as one frame; empty, with its schema, when none is."""
    return split_by_health(parse_bars(payloads, types), unit)[0]


def export_csv(bars: DataFrame, folder: str) -> None:
    """Write bars as CSV with a header line."""
    bars.write.option("header", True).csv(folder)
