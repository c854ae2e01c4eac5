"""Files and tables that the queries derive from the given tables, each in a place of its own."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.moments import record_text
from tickloom.operators.ticks import bars
from tickloom.registry import views
from tickloom.session import scratch_path
from tickloom.sources import klines, lake, relational

RECORDS_PER_FILE = 5000
SHORT_RUN = 200
JDBC_URL = "spark.tickloom.jdbc.url"


def new_table(spark: SparkSession, label: str) -> str:
    """Name of a table that does not exist yet, in this session's database in the shared folder."""
    database = "checks_" + spark.sparkContext.applicationId.replace("-", "_")
    if not spark.catalog.databaseExists(database):
        lake.open_database(spark, database, scratch_path(spark, "lake"))
    return f"{database}.{label}_{uuid.uuid4().hex[:12]}"


def tick_table(spark: SparkSession, folder: str) -> str:
    """All ticks as a lake table partitioned by asset and date."""
    name = new_table(spark, "ticks")
    lake.insert_to_table(views.ticks(spark, folder), name, {"id": "bigint"}, ["asset", "scraped_date"])
    return name


def tick_records(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks as landing records: texts for time and price."""
    return views.ticks(spark, folder).select(
        "id",
        record_text(F.col("scraped_timestamp")).alias("timestamp"),
        "asset",
        F.col("price").cast("string").alias("price"),
        "source_id",
        F.col("engine_id").alias("engine"),
    )


def landing_folder(spark: SparkSession, folder: str) -> str:
    """Every tick as JSON: of each run of ids the first alone in a file, the rest as a list in another."""
    path = scratch_path(spark, "landing")
    land_runs(tick_records(spark, folder), path, RECORDS_PER_FILE)
    return path


def flawed_landing_folder(spark: SparkSession, folder: str) -> str:
    """As :func:`landing_folder` with short runs; of each third run one file is cut off, of the next one a price is no number."""
    run, at = F.floor(F.col("id") / SHORT_RUN), F.col("id") % SHORT_RUN
    records = tick_records(spark, folder)
    priced = records.withColumn("price", F.when((run % 3 == 2) & (at == 1), "n/a").otherwise(F.col("price")))
    path = scratch_path(spark, "landing")
    land_runs(priced, path, SHORT_RUN, cut_off=F.col("run") % 3 == 1)
    return path


def land_runs(records: DataFrame, path: str, per_run: int, cut_off: Column | None = None) -> None:
    """Add the files of the records to a folder; files of single records end early where ``cut_off`` is true."""
    record = F.to_json(F.struct("timestamp", "asset", "price", "source_id", "engine")).alias("record")
    records = records.select("id", record)
    run, alone = F.floor(F.col("id") / per_run), F.col("id") % per_run == 0
    grouped = records.groupBy(run.alias("run"), alone.alias("alone")).agg(F.listagg("record", F.lit(",")).alias("body"))
    single = F.col("body") if cut_off is None else F.when(cut_off, F.expr("left(body, length(body) - 10)")).otherwise(F.col("body"))
    document = F.when(F.col("alone"), single).otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    # Tasks move their many files into place; otherwise the driver moves one after the other.
    writer = grouped.select(document.alias("value")).write.mode("append").option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def mark_files(spark: SparkSession, folder: str) -> str:
    """The marks without ``opened_at`` as four files, earlier days in earlier files."""
    path = scratch_path(spark, "marks")
    marks = views.marks(spark, folder).drop("opened_at")
    for part in range(4):
        of_part = F.least(F.floor((F.dayofmonth("mark_time") - 1) / 8), F.lit(3)) == part
        marks.filter(of_part).coalesce(1).write.mode("append").parquet(path)
    return path


def kline_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of the ticks as captured payloads, one per asset and day.

    Of ``error`` one day has prices that are no numbers, of ``signup`` one day lacks the trade counts.
    """
    hourly = bars(views.ticks(spark, folder), "1 hour").withColumn("day", F.to_date(F.timestamp_millis("open_time")))
    broken = (F.col("asset") == "error") & (F.col("day") == F.lit("2024-01-05").cast("date"))
    lacking = (F.col("asset") == "signup") & (F.col("day") == F.lit("2024-01-10").cast("date"))
    quoted = [
        F.when(broken, "n/a").otherwise(F.col("open").cast("string")),
        *[F.col(name).cast("string") for name in ("high", "low", "close", "volume")],
        F.col("close_time").cast("string"),
        (F.col("volume") * F.col("close")).cast("string"),
        F.when(~lacking, F.col("number_of_trades").cast("string")),
        (F.col("volume") / 2).cast("string"),
        (F.col("volume") * F.col("close") / 2).cast("string"),
        F.lit("0"),
    ]
    bar = F.array(F.col("open_time").cast("string"), *quoted)
    payload = F.to_json(F.array_sort(F.collect_list(bar))).alias("payload")
    return hourly.groupBy("asset", F.col("day").alias("scraped_time")).agg(payload)


def captured_files(spark: SparkSession, folder: str) -> str:
    """:func:`kline_payloads` as captured files, and a stray file whose name tells no asset and time."""
    path = scratch_path(spark, "captures")
    payloads = kline_payloads(spark, folder)
    klines.write_captures(payloads, path)
    stray = payloads.filter(F.col("asset") == "click").groupBy().agg(F.min_by("payload", "scraped_time").alias("value"))
    stray.withColumn("copied", F.lit("notes")).write.mode("append").partitionBy("copied").text(path)
    return path


def jdbc_url(spark: SparkSession) -> str:
    """The database named in the session, or one inside this process.

    The latter is seen by this process only, so it serves a local session; a cluster needs the setting.
    """
    named = spark.conf.get(JDBC_URL, None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {JDBC_URL} to a database that every executor can reach")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return "jdbc:derby:memory:tickloom;create=true"


def jdbc_tick_table(spark: SparkSession, folder: str) -> tuple[str, str]:
    """All ticks in a table of the relational database: (url, table)."""
    url, name = jdbc_url(spark), f"ticks_{uuid.uuid4().hex[:12]}"
    columns = "id bigint not null primary key, asset varchar(32), scraped_timestamp timestamp, price double precision"
    relational.execute(spark, url, [f"CREATE TABLE {name} ({columns})"])
    rows = views.ticks(spark, folder).select("price", "id", "scraped_timestamp", "asset")
    relational.append_rows(rows, url, name)
    return url, name
