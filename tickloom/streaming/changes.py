"""Results of streams, kept as parts that add up.

Every micro-batch writes one combined row per key it touched into its own ``batch`` folder. A *merge* is an aggregate
over such rows that gives rows of the same columns, so parts of parts add up to the whole: sums, maxima, newest items.
The result is the merge of all parts. Nothing is held between batches, so no row is too late and no state grows, and a
batch that is run again overwrites its folder and counts once. Only folders that Spark has marked as finished are read.

Every tenth batch merges the ten last into one ``span`` folder, every hundredth ten of those, and so on; the folders merged
go when the next ten are. So a read takes, and the folder holds, some twenty parts for each decimal of the number of
batches, without anybody's help. :func:`compact` merges all into one ``upto`` folder and can let rows go.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame], DataFrame]

_BATCH, _SPAN, _BASE, _INTENT = "batch", "span", "upto", "intent"
FAN_IN = 10

#: First and last batch, and path.
Part = tuple[int, int, str]


def write_parts(
    rows: DataFrame, folder: str, checkpoint: str, merge: Merge, reduce: Merge | None = None, **trigger
) -> StreamingQuery:
    """Start the stream; by default it takes what is there and ends.

    ``reduce`` turns the rows of a batch into such as ``merge`` takes; without it they already are.
    """

    return (
        rows.writeStream.foreachBatch(lambda batch, number: write_part(batch if reduce is None else reduce(batch), folder, number, merge))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_part(batch: DataFrame, folder: str, number: int, merge: Merge) -> None:
    """Write one batch, and merge the parts of every span that it completes."""
    spark = batch.sparkSession
    merge(batch).write.mode("overwrite").parquet(f"{folder}/{_BATCH}={number}")
    size = FAN_IN
    while (number + 1) % size == 0:
        first = number + 1 - size
        base, parts = _listed(spark, folder, before=(first, number))
        if first > base and len(parts) > 1 and parts[0][0] == first:
            merge(_read(spark, parts)).write.mode("overwrite").parquet(f"{folder}/{_SPAN}={first}-{number}")
        _remove_within(spark, folder, first - size, first - 1)
        size *= FAN_IN


def finished_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of all finished ``batch`` folders, partition columns below them included; none gives an empty frame."""
    paths = [path for _, _, path in _finished(spark, folder, _BATCH)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths).select(*schema.names)


def current(spark: SparkSession, folder: str, merge: Merge) -> DataFrame:
    """The result of all finished batches."""
    return merge(_read(spark, _parts(spark, folder)))


def compact(spark: SparkSession, folder: str, merge: Merge, keep: Merge | None = None) -> int:
    """Merge all finished batches into a new base, while the stream may go on, and return its number.

    ``keep`` leaves rows out of the base, such as expired items. Of the older folders those go that the base before this
    one had made superfluous, so a reader that has just listed its folders still finds them. One compaction runs at a time.
    """
    last = _parts(spark, folder)[-1][1]
    intent = _path(spark, f"{folder}/{_INTENT}={last}")
    files = intent.getFileSystem(spark._jsc.hadoopConfiguration())
    # Seen by the stream, which keeps the parts of a span that goes beyond this base.
    files.mkdirs(intent)
    base, parts = _listed(spark, folder, until=last)
    if last != base:
        parts = ([(-1, base, f"{folder}/{_BASE}={base}")] if base >= 0 else []) + parts
        rows = merge(_read(spark, parts))
        rows = rows if keep is None else keep(rows)
        rows.write.mode("overwrite").parquet(f"{folder}/{_BASE}={last}")
        if base >= 0:
            _remove_until(spark, folder, base)
    files.delete(intent, True)
    return last


def _parts(spark: SparkSession, folder: str) -> list[Part]:
    """The newest finished base, as part from -1, and the parts after it."""
    base, parts = _listed(spark, folder)
    parts = ([(-1, base, f"{folder}/{_BASE}={base}")] if base >= 0 else []) + parts
    if not parts:
        raise ValueError(f"{folder} holds no finished batch")
    return parts


def _listed(spark: SparkSession, folder: str, until: int | None = None, before: tuple[int, int] | None = None) -> tuple[int, list[Part]]:
    """The newest base, -1 without one, and the largest finished parts after it, in order, up to batch ``until``.

    With ``before`` only parts inside that span, itself left out. A span that begins before the base would count batches
    twice; the parts it was made of are used instead.
    """
    base = max((last for _, last, _ in _finished(spark, folder, _BASE)), default=-1)
    found = _finished(spark, folder, _BATCH) + _finished(spark, folder, _SPAN)
    found = [part for part in found if part[0] > base and (until is None or part[1] <= until)]
    if before is not None:
        found = [part for part in found if before[0] <= part[0] and part[1] <= before[1] and part[:2] != before]
    chosen: list[Part] = []
    for part in sorted(found, key=lambda part: (part[0], -part[1])):
        if not chosen or part[0] > chosen[-1][1]:
            chosen.append(part)
    return base, chosen


def _read(spark: SparkSession, parts: Sequence[Part]) -> DataFrame:
    return spark.read.parquet(*[path for _, _, path in parts])


def _finished(spark: SparkSession, folder: str, kind: str) -> list[Part]:
    """Folders of a kind; the writer marks a folder when all its files are in place."""
    found = _matching(spark, f"{folder}/{kind}=*/_SUCCESS")
    return [(*_span(path), path.rsplit("/", 1)[0]) for path in found]


def _remove_within(spark: SparkSession, folder: str, first: int, last: int) -> None:
    """Remove the parts that the finished span of these batches was made of, unless a base ends or may end inside it."""
    if (first, last) not in [part[:2] for part in _finished(spark, folder, _SPAN)]:
        return
    ends = [_span(path)[1] for kind in (_BASE, _INTENT) for path in _matching(spark, f"{folder}/{kind}=*")]
    if any(first <= end < last for end in ends):
        return
    for kind in (_BATCH, _SPAN):
        for path in _matching(spark, f"{folder}/{kind}=*"):
            own = _span(path)
            if first <= own[0] and own[1] <= last and own != (first, last):
                _delete(spark, path)


def _remove_until(spark: SparkSession, folder: str, base: int) -> None:
    """Remove the parts that ``base`` contains and the bases before it."""
    for kind, past in ((_BATCH, base + 1), (_SPAN, base + 1), (_BASE, base)):
        for path in _matching(spark, f"{folder}/{kind}=*"):
            if _span(path)[1] < past:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = _path(spark, path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    path = _path(spark, pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [entry.getPath().toString() for entry in found or []]


def _span(path: str) -> tuple[int, int]:
    """First and last batch that a folder's name tells; one number is both."""
    found = re.search(rf"/(?:{_BATCH}|{_SPAN}|{_BASE}|{_INTENT})=(\d+)(?:-(\d+))?(?:/|$)", path)
    return int(found[1]), int(found[2] or found[1])
