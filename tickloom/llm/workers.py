"""Makes this package importable in the Python workers of whatever cluster the session runs on."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from tickloom.session import scratch_path

#: Bytes of one Arrow batch: what a task holds of it, in the JVM and in Python, several times over.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

PACKAGE = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors, once per application, and bound the session's Arrow batches."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="sources-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(PACKAGE.rglob("*.py")):
            target.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def hand_out(spark: SparkSession, label: str, pieces: Iterable[bytes]) -> str:
    """Write bytes, piece by piece, to the shared folder and give the file to every executor; its name for :func:`mapped`."""
    name = f"{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, label).rpartition('/')[0]}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        for piece in pieces:
            stream.write(bytearray(piece))
    finally:
        stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def mapped(name: str, kind: type) -> np.ndarray:
    """A handed-out file as a read-only array in the pages of the operating system, which all workers of a machine share."""
    path = Path(SparkFiles.get(name))
    return np.memmap(path, kind, "r") if path.stat().st_size else np.empty(0, kind)


def tidied(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """For functions over Arrow batches: give free memory back when a task ends, since workers outlive their tasks."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
