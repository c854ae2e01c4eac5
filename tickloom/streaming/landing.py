"""Landing files as a stream that survives bad ones, and the state of every file.

A file is one row, its whole text. Files that hold no records, and records with a value that does not fit, go to a reject
table with the name of their file and their text; all other records land. One micro-batch reads and screens its files once
and writes the landed records, the rejects and a list of its files into folders of its own, so a batch that runs again
replaces them and counts once.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.text import base_name
from tickloom.session import set_unless_given
from tickloom.sources.landing import TICK_NAMES, TICK_SCHEMA, TICK_TYPES
from tickloom.streaming.changes import finished_batches

LANDED, REJECTED, FILES = "landed", "rejected", "files"
_REJECTS = "source_file string, reason string, text string"
_LIST = "source_file string, records bigint, rejects bigint"
# The source looks through all files anew when it has handed out so many, and writes the list of those seen anew after so
# many batches; both are whole passes, so rare ones keep a long run of batches from growing with the square of the files.
_FILES_AHEAD = 100_000
_SETTINGS = {
    "spark.sql.streaming.fileSource.log.compactInterval": "100",
    "spark.sql.streaming.fileSource.cleaner.numThreads": "8",
}
# Else listing a batch starts a task for each of its files.
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def file_stream(spark: SparkSession, folder: str, archive: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """``source_file, text`` of each file of a folder, once.

    ``files_per_batch`` limits what a micro-batch takes. With ``archive`` a file moves there once a later batch starts.
    """
    # The source reads its settings from the session, as long as the stream runs.
    set_unless_given(spark, {**_SETTINGS, _LISTING_TASKS: str(2 * spark.sparkContext.defaultParallelism)})
    reader = spark.readStream.option("maxCachedFiles", _FILES_AHEAD)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def _lands(record: Column) -> Column:
    return record["reason"].isNull()


class RecordFormat:
    """Fields of a record, the names they get and the types their values must fit."""

    def __init__(self, schema: str = TICK_SCHEMA, names: Mapping[str, str] = TICK_NAMES, types: Mapping[str, str] = TICK_TYPES) -> None:
        fields = T.StructType.fromDDL(schema).fields
        self.fields = [field.name for field in fields]
        self.names = [names.get(field.name, field.name) for field in fields]
        self.types = [types.get(name, field.dataType.simpleString()) for name, field in zip(self.names, fields)]

    def screened(self, files: DataFrame) -> DataFrame:
        """A row per file: ``source_file``, its ``text`` if it holds no records, and ``records``.

        A record has its values typed, or the ``reason`` why it does not land and its ``text``. A file may hold an object or
        a list of objects; a blank one holds none, and as in a batch read nothing is looked for after the first of them. All
        values are read as text and cast one by one, so that the reject says which does not fit. A field that a record lacks
        is null.
        """
        parsed, screened = self._screening
        return files.select(*parsed).select(*screened)

    def good(self, screened: DataFrame) -> DataFrame:
        """The records of :meth:`screened` files that land, and ``source_file``."""
        each, lands, values = self._landing
        return screened.select(*each).filter(lands).select(*values)

    def rejects(self, screened: DataFrame) -> DataFrame:
        """``source_file, reason, text`` of what does not land of :meth:`screened` files: whole files, and records."""
        return screened.select(*self._rejecting)

    def counted(self, screened: DataFrame) -> DataFrame:
        """``source_file, records, rejects`` of :meth:`screened` files."""
        return screened.select(*self._counting)

    # Columns are made once; with short batches making them anew would take a good part of the time.

    @cached_property
    def _screening(self) -> tuple[list[Column], list[Column]]:
        texts = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in self.fields]))
        blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", F.lit(True))
        found = F.when(blank, F.array().cast(texts)).otherwise(F.from_json("text", texts))
        file, records = F.col("source_file"), F.col("records")
        broken = F.when(records.isNull(), F.coalesce("text", F.lit("")))
        judged = F.transform(records, self._judged)
        return [file, F.col("text"), found.alias("records")], [file, broken.alias("text"), judged.alias("records")]

    def _judged(self, record: Column) -> Column:
        values = [record[name].try_cast(kind) for name, kind in zip(self.fields, self.types)]
        lost = [F.when(record[name].isNotNull() & value.isNull(), F.lit(name)) for name, value in zip(self.fields, values)]
        reason = F.when(record.isNull(), "no object").otherwise(F.concat(F.lit("value of "), F.coalesce(*lost)))
        text = F.when(reason.isNotNull(), F.coalesce(F.to_json(record), F.lit("null")))
        typed = F.struct(*[value.alias(name) for name, value in zip(self.names, values)])
        return F.struct(reason.alias("reason"), text.alias("text"), typed.alias("values"))

    @cached_property
    def _landing(self) -> tuple[list[Column], Column, list[Column]]:
        file, record = F.col("source_file"), F.col("record")
        values = [record["values"][name].alias(name) for name in self.names]
        return [file, F.explode("records").alias("record")], _lands(record), [*values, file]

    @cached_property
    def _rejecting(self) -> list[Column]:
        whole = F.array(F.struct(F.lit("no records").alias("reason"), "text"))
        flawed = F.transform(F.filter("records", lambda r: ~_lands(r)), lambda r: F.struct(r["reason"], r["text"]))
        found = F.when(F.col("text").isNotNull(), whole).otherwise(flawed)
        return [F.col("source_file"), F.inline(found).alias("reason", "text")]

    @cached_property
    def _counting(self) -> list[Column]:
        broken = F.col("text").isNotNull()
        sound, flawed = (F.size(F.filter("records", kept)).cast("long") for kept in (_lands, lambda r: ~_lands(r)))
        none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        records, rejects = F.when(broken, none).otherwise(sound), F.when(broken, one).otherwise(flawed)
        return [F.col("source_file"), records.alias("records"), rejects.alias("rejects")]

    def schema(self) -> T.StructType:
        pairs = zip([*self.names, "source_file"], [*self.types, "string"])
        return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in pairs))


def land_files(files: DataFrame, folder: str, checkpoint: str, form: RecordFormat | None = None, **trigger) -> StreamingQuery:
    """Land a :func:`file_stream` into ``folder``: records, rejects and the list of files; by default what is there, then end."""
    form = form or RecordFormat()

    # The list has short rows, so a quarter of the cores will do.
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism // 4)

    def save(batch: DataFrame, number: int) -> None:
        screened = form.screened(batch).persist()
        outputs = {LANDED: form.good(screened), REJECTED: form.rejects(screened), FILES: form.counted(screened).coalesce(tasks)}
        write = inheritable_thread_target(batch.sparkSession)(lambda kind: _write(outputs[kind], folder, kind, number))
        try:
            # At once, as most of a small batch is the start and the end of its jobs.
            with ThreadPoolExecutor(len(outputs)) as pool:
                list(pool.map(write, outputs))
        finally:
            screened.unpersist()

    return (
        files.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _write(rows: DataFrame, folder: str, kind: str, number: int) -> None:
    # Tasks move their files into place; nobody reads a folder before its job has marked it as finished.
    writer = rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.parquet(f"{folder}/{kind}/batch={number}")


def landed(spark: SparkSession, folder: str, form: RecordFormat | None = None) -> DataFrame:
    """All landed records of finished batches."""
    return finished_batches(spark, f"{folder}/{LANDED}", (form or RecordFormat()).schema())


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file, reason, text`` of all that did not land."""
    return finished_batches(spark, f"{folder}/{REJECTED}", T.StructType.fromDDL(_REJECTS))


def processed(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file, records, rejects`` of all files that finished batches took."""
    return finished_batches(spark, f"{folder}/{FILES}", T.StructType.fromDDL(_LIST))


def lifecycle(spark: SparkSession, source: str, archive: str, folder: str) -> DataFrame:
    """Every file by base name with its ``state``: ``pending``, ``landed`` (still in the source folder) or ``archived``.

    Names are listed by tasks and told apart without reading contents. Archived are files that lie in ``archive``. ``batch`` tells
    which micro-batch took a file, null while it is pending.
    """
    name = lambda path: base_name(F.col(path))
    waiting = listed(spark, source).select(name("path").alias("file"), F.lit(False).alias("moved"))
    moved = listed(spark, archive).select(name("path").alias("file"), F.lit(True).alias("moved"))
    taken = spark.read.schema(f"{_LIST}, batch int").option("basePath", f"{folder}/{FILES}").parquet(f"{folder}/{FILES}")
    taken = taken.groupBy(name("source_file").alias("file")).agg(F.max("batch").alias("batch"), F.sum("records").alias("records"))
    found = waiting.unionAll(moved).join(taken, "file", "left")
    state = F.when(F.col("moved"), "archived").when(F.col("batch").isNotNull(), "landed").otherwise("pending")
    return found.select("file", state.alias("state"), "batch", F.coalesce("records", F.lit(0)).alias("records"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every file below a folder that is not empty; a folder that does not exist has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
