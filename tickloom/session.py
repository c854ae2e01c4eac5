"""Session settings and the shared folder in which jobs stage data."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "tickloom", **settings: str) -> SparkSession:
    """Session with the settings the jobs are written for; deployment settings come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def set_unless_given(spark: SparkSession, settings: Mapping[str, str]) -> None:
    """Session settings that a job works better with, those that the deployment gives left as they are."""
    given = spark.conf.getAll
    for key, value in settings.items():
        if key not in given:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a single-JVM local session may fall back to a temporary folder: on a cluster the other machines
    could not see it, so a missing setting is an error there.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A free path in a new folder under the shared one; the folder goes when the driver ends."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps start from stable files.

    The files last as long as the session, since the returned frame reads them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """:func:`written`, and how many rows were written, counted by the tasks that write them."""
    counted = Observation()
    rows = written(df.observe(counted, F.count(F.lit(1)).alias("rows")), label)
    return rows, counted.get["rows"]


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after counting that it holds at most ``max_rows`` rows; otherwise a plain join side.

    The whole frame is counted, by all tasks. Give it one that is cheap to count, such as one returned by
    :func:`written`, whose counts stand in the files' footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
