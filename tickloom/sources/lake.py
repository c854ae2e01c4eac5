"""Partitioned lake tables in the session catalog.

Tables are managed Parquet tables of a database whose location is the lake folder, so the catalog knows their
partitions and dropping one removes its files. Changes rewrite only the partitions they touch.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.shaping import all_of, strict_cast
from tickloom.session import broadcast_if_small, written

MODES = ("append", "overwrite", "overwrite_partitions")
# Partition tuples joined by broadcast; more are joined by shuffle. A tuple is well below a kilobyte.
MAX_BROADCAST_PARTITIONS = 20_000
_PER_STATEMENT = 100
# Fixed value: how catalogs write a null partition value.
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
# Below the table's folder; hidden, so that no listing of the table takes them for data.
_VERSIONS, _EMPTY = "_versions", "empty"
_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
_ONE_MODE_AT_A_TIME = threading.RLock()


@dataclass(frozen=True)
class RunStats:
    """What one run did."""

    rows: int
    runtime_s: float
    scanned_mb: float | None = None


def open_database(spark: SparkSession, name: str, location: str) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{location}'")
    return name


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [column.name for column in spark.catalog.listColumns(table) if column.isPartition]


def create_table(df: DataFrame, table: str, partitions: Sequence[str] = ()) -> None:
    """Create an empty table with the schema of ``df`` unless it exists."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], df.schema)
        empty.write.format("parquet").partitionBy(*partitions).saveAsTable(table)


def insert_to_table(
    df: DataFrame,
    table: str,
    data_schema: Mapping[str, str],
    partitions: Sequence[str],
    mode: str = "overwrite_partitions",
) -> None:
    """Cast strictly, then add the rows.

    ``append`` adds, ``overwrite`` replaces the whole table, ``overwrite_partitions`` replaces the partitions
    that occur in ``df`` and leaves the others. Columns go by name. The rows are rebalanced on the partition
    columns, which splits large partitions over several tasks and packs small ones.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    typed = strict_cast(df, data_schema)
    create_table(typed, table, partitions)
    _insert(typed, table, mode)


def _insert(df: DataFrame, table: str, mode: str) -> None:
    spark = df.sparkSession
    partitions = partition_columns(spark, table)
    rows = _fitting(df, table)
    rows = rows.hint("rebalance", *partitions) if partitions else rows
    dynamic = mode == "overwrite_partitions" and bool(partitions)
    with _overwriting(spark, "dynamic" if dynamic else "static"):
        rows.write.mode("append" if mode == "append" else "overwrite").insertInto(table)


def _fitting(df: DataFrame, table: str) -> DataFrame:
    """The columns of ``df`` in the table's order. Columns the table does not have are an error, nothing is dropped."""
    columns = df.sparkSession.table(table).columns
    unknown = [name for name in df.columns if name.lower() not in {known.lower() for known in columns}]
    if unknown:
        raise ValueError(f"{table} has no column {', '.join(unknown)}")
    return df.select(*columns)


@contextmanager
def _overwriting(spark: SparkSession, mode: str) -> Iterator[None]:
    """Set the overwrite mode of catalog tables, which they take from the session only, for one write.

    Threads that share a session write one after the other, so none writes in the mode of another.
    """
    with _ONE_MODE_AT_A_TIME:
        before = spark.conf.get(_OVERWRITE_MODE)
        spark.conf.set(_OVERWRITE_MODE, mode)
        try:
            yield
        finally:
            spark.conf.set(_OVERWRITE_MODE, before)


def delete_all(spark: SparkSession, table: str) -> None:
    """Remove every row; the table and its schema stay."""
    _insert(spark.createDataFrame([], spark.table(table).schema), table, "overwrite")


def delete_rows(spark: SparkSession, table: str, conditions: Sequence[str | Column]) -> None:
    """Delete the rows for which all conditions are true. Rows where they are unknown stay."""
    _replace(spark, table, conditions, None)


def delete_insert(df: DataFrame, table: str, conditions: Sequence[str | Column]) -> None:
    """Delete as :func:`delete_rows` does and add ``df``, both at one moment in the partitions concerned."""
    _replace(df.sparkSession, table, conditions, df)


def _replace(spark: SparkSession, table: str, conditions: Sequence[str | Column], new: DataFrame | None) -> None:
    """Write what the touched partitions hold afterwards once, into new folders, then let the catalog point to these.

    Until that one catalog call the table is as before, whatever fails. Partitions that conditions on partition columns alone
    select are found in the catalog and not read; the folders of before are removed last.
    """
    doomed = F.coalesce(all_of(conditions), F.lit(False))
    current = spark.table(table)
    partitions = partition_columns(spark, table)
    if not partitions:
        result = current.filter(~doomed)
        result = result if new is None else result.unionByName(_fitting(new, table))
        _insert(written(result, "replaced"), table, "overwrite")
        return
    known = _catalog_partitions(spark, table, partitions)
    folder = f"{_location(spark, table)}/{_VERSIONS}/{uuid.uuid4().hex}"
    added = set()
    if new is not None:
        _write_partitions(_fitting(new, table), folder, partitions)
        added = _partition_paths(spark, folder, len(partitions))
    emptied = _selected_whole(known, conditions)
    if emptied is not None:
        hit = {row.path for row in emptied.select("path").toLocalIterator()}
        beside = known.filter(F.col("path").isin(*added - hit)) if added - hit else None
        kept = None if beside is None else _within(current, beside, partitions)
    else:
        tuples = written(current.filter(all_of(conditions)).select(*partitions).distinct(), "touched")
        side = broadcast_if_small(tuples, MAX_BROADCAST_PARTITIONS)
        same = all_of([known[name].eqNullSafe(side[name]) for name in partitions])
        hit = {row.path for row in known.join(side, same, "left_semi").select("path").toLocalIterator()}
        touched = known.filter(F.col("path").isin(*hit | added)) if hit | added else None
        kept = None if touched is None else _within(current, touched, partitions).filter(~doomed)
    if kept is not None:
        _write_partitions(kept, folder, partitions)
    if hit or added:
        _move_partitions(spark, table, folder, hit | added, _partition_paths(spark, folder, len(partitions)))


def _catalog_partitions(spark: SparkSession, table: str, partitions: Sequence[str]) -> DataFrame:
    """``path`` (``name=value/...`` as the catalog writes it) and the typed values of every partition, without reading any."""
    paths = [(row[0],) for row in spark.sql(f"SHOW PARTITIONS {table}").toLocalIterator()]
    rows = spark.createDataFrame([(path, [_unescaped(part) for part in path.split("/")]) for (path,) in paths], "path string, parts array<string>")
    types = {field.name: field.dataType for field in spark.table(table).schema}
    return rows.select("path", *[F.get("parts", F.lit(i)).cast(types[name]).alias(name) for i, name in enumerate(partitions)])


def _unescaped(part: str) -> str | None:
    value = unquote(part.partition("=")[2])
    return None if value == _NULL_PARTITION else value


def _selected_whole(known: DataFrame, conditions: Sequence[str | Column]) -> DataFrame | None:
    """The partitions all of whose rows fulfil the conditions, if these name partition columns only; else None."""
    try:
        return known.filter(all_of(conditions))
    except AnalysisException:
        return None


def _write_partitions(rows: DataFrame, folder: str, partitions: Sequence[str]) -> None:
    rows.hint("rebalance", *partitions).write.mode("append").partitionBy(*partitions).parquet(folder)


def _partition_paths(spark: SparkSession, folder: str, depth: int) -> set[str]:
    """The partition folders below ``folder``, as the catalog names them."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{'/'.join(['*=*'] * depth)}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return {"/".join(entry.getPath().toString().split("/")[-depth:]) for entry in found or []}


def _location(spark: SparkSession, table: str) -> str:
    return _catalog(spark).getTableMetadata(_identifier(spark, table)).location().toString().rstrip("/")


def _catalog(spark: SparkSession):
    return spark._jsparkSession.sessionState().catalog()


def _identifier(spark: SparkSession, table: str):
    return spark._jsparkSession.sessionState().sqlParser().parseTableIdentifier(table)


def _move_partitions(spark: SparkSession, table: str, folder: str, touched: set[str], filled: set[str]) -> None:
    """Point all touched partitions to their folders below ``folder`` in one catalog call; drop those that are empty there."""
    catalog, identifier, jvm = _catalog(spark), _identifier(spark, table), spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    partitions = partition_columns(spark, table)
    empty = f"{folder}/{_EMPTY}"
    files.mkdirs(jvm.org.apache.hadoop.fs.Path(empty))
    spec = lambda path: "PARTITION (" + ", ".join(f"`{n}` = {_literal(_unescaped(p))}" for n, p in zip(partitions, path.split("/"))) + ")"
    known = {row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").toLocalIterator()}
    missing = sorted(touched - known)
    # New partitions first appear empty, so that their rows come with the same call as all others.
    for begin in range(0, len(missing), _PER_STATEMENT):
        added = " ".join(f"{spec(path)} LOCATION '{empty}'" for path in missing[begin : begin + _PER_STATEMENT])
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")
    moved, before = jvm.java.util.ArrayList(), []
    for path in sorted(touched):
        values = jvm.java.util.HashMap()
        for name, part in zip(partitions, path.split("/")):
            values.put(name, unquote(part.partition("=")[2]))
        partition = catalog.getPartition(identifier, jvm.PythonUtils.toScalaMap(values))
        before.append(partition.location().toString())
        target = jvm.java.net.URI(jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}" if path in filled else empty).toUri().toString())
        moved.add(_changed(partition, storage=_changed(partition.storage(), locationUri=jvm.scala.Some(target))))
    catalog.alterPartitions(identifier, jvm.PythonUtils.toSeq(moved))
    spark.catalog.refreshTable(table)
    emptied = sorted(touched - filled)
    for begin in range(0, len(emptied), _PER_STATEMENT):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(map(spec, emptied[begin : begin + _PER_STATEMENT]))}")
    for old in before:
        if not old.startswith(folder):
            files.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(old)), True)


def _changed(record, **values):
    """A copy of a catalog record with some of its fields replaced."""
    names = [record.productElementName(i) for i in range(record.productArity())]
    return record.copy(*[values.get(name, record.productElement(i)) for i, name in enumerate(names)])


def _within(rows: DataFrame, tuples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose values of ``columns`` are among ``tuples``, null matching null.

    The range of each column, one small row, becomes literal bounds, so that partitions outside are not read.
    """
    spans = [
        c
        for name in columns
        for c in (
            F.min(name).alias(f"{name}_low"),
            F.max(name).alias(f"{name}_high"),
            F.coalesce(F.bool_or(F.col(name).isNull()), F.lit(False)).alias(f"{name}_null"),
        )
    ]
    span = tuples.agg(*spans).first()
    for name in columns:
        inside = F.col(name).between(F.lit(span[f"{name}_low"]), F.lit(span[f"{name}_high"]))
        rows = rows.filter(inside | F.col(name).isNull() if span[f"{name}_null"] else inside)
    side = broadcast_if_small(tuples.select(*columns), MAX_BROADCAST_PARTITIONS)
    same = all_of([rows[name].eqNullSafe(side[name]) for name in columns])
    return rows.join(side, same, "left_semi")


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'" if type(value) is date else f"'{value}'"
    if isinstance(value, (int, float)):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def measured_insert(df: DataFrame, table: str, mode: str, sources: Sequence[DataFrame] = ()) -> RunStats:
    """Insert and report rows, run time and, given the source frames, the size of their files."""
    started = time.monotonic()
    counted = Observation()
    _insert(df.observe(counted, F.count(F.lit(1)).alias("rows")), table, mode)
    runtime = time.monotonic() - started
    return RunStats(counted.get["rows"], runtime, sum(map(scanned_mb, sources)) if sources else None)


def aggregate_to_table(
    spark: SparkSession,
    query: str,
    table: str,
    *,
    mode: str = "append",
    args: Mapping[str, object] | None = None,
    sources: Sequence[DataFrame] = (),
) -> RunStats:
    """Run a parameterised query into a table. ``delete_insert`` replaces the contents, ``append`` adds.

    Replacing is one overwrite: the old rows stay until the new ones are complete.
    """
    if mode not in ("append", "delete_insert"):
        raise ValueError("mode must be append or delete_insert")
    result = spark.sql(query, args=dict(args or {}))
    create_table(result, table)
    return measured_insert(result, table, "overwrite" if mode == "delete_insert" else "append", sources)


def scanned_mb(source: DataFrame) -> float:
    """Size of the files a frame reads after partition pruning, taken from file metadata only."""
    files = source.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n")).distinct()
    return (files.agg(F.sum("n")).first()[0] or 0) / (1024.0 * 1024.0)
