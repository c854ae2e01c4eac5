"""Best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.scan import slices
from tickloom.llm.tokens import SLICE_BYTES, encoder
from tickloom.llm.workers import ship, tidied
from tickloom.operators.segments import free_name
from tickloom.session import written

CAPACITY = 2048
OPEN_BINS = 256
PIECES_PER_TASK = 100_000
_ID_BYTES = 4


class OpenBins:
    """Bounded-space best fit: bit f of ``free`` is set while an open bin has f free places."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.free, self.open, self.made = 0, 0, 0
        self.bins: dict[int, list[int]] = defaultdict(list)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of ``length`` places."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        """The oldest open bin with this much space; it is open no longer."""
        own = self.bins[space]
        number = own.pop(0)
        if not own:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def cuts(count: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a document of ``count`` ids: whole if it fits, else full ones after the rest."""
    begin, end = 0, count % capacity or min(capacity, count)
    while begin < count:
        yield begin, end
        begin, end = end, end + capacity


def token_pieces(
    df: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document's ids, ``end_id`` last: key, ``piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A null or empty text has the one id ``end_id``. Rows that repeat give pieces that repeat.
    """
    ship(df.sparkSession)
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                tokens = own.tokens(part)
                packed, at = tokens.ids().tobytes(), 0
                source, piece, start, found = [], [], [], []
                for row, count in enumerate(tokens.counts.tolist()):
                    ids = packed[at : at + count * _ID_BYTES] + last
                    at += count * _ID_BYTES
                    for number, (begin, end) in enumerate(cuts(count + 1, capacity)):
                        source.append(row)
                        piece.append(number)
                        start.append(begin)
                        found.append(ids[begin * _ID_BYTES : end * _ID_BYTES])
                columns = [
                    part.rows.column(0).take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(ids) // _ID_BYTES for ids in found], pa.int64()),
                    pa.array([zlib.crc32(ids) for ids in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found, pa.binary())] * with_ids, names)

    fields = [
        T.StructField("key", df.schema[key].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.BinaryType())] * with_ids
    cut_up = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(tidied(tokenise), T.StructType(fields))
    return cut_up.withColumnRenamed("key", key)


def best_fit(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    The pieces are written once with a number each and dealt by the hash of their columns and that number to tasks of some
    ``pieces_per_task``, so that rows that repeat are spread as well; each task packs its own, in hash order, with
    ``open_bins`` open bins. A piece goes into the open bin it leaves least space in; if none fits, a new bin opens, and at
    the limit the fullest closes first. So memory is that of the open bins, and a task that runs again packs the same way.
    """
    ship(pieces.sparkSession)
    given = pieces.schema.fields
    number = free_name(pieces, "number")
    pieces = written(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    names = [*[field.name for field in given], "sequence_id", "offset"]
    at = pieces.columns.index("length")

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column(at).to_pylist()], np.int64).reshape(-1, 2)
            columns = [*batch.columns[:-1], pa.array(placed[:, 0] + first), pa.array(placed[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names)

    order = F.xxhash64(*[F.col(f"`{name}`") for name in pieces.columns if name != "ids"])
    dealt = pieces.repartition(tasks, order).sortWithinPartitions(order, number)
    schema = T.StructType([*given]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return dealt.mapInArrow(tidied(pack_rows), schema)


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Tokenise, cut and pack all documents: a row per piece with its place; ``with_ids=True`` keeps the ids.

    Empty tables give no rows. Columns other than key and text are not read.
    """
    return best_fit(token_pieces(df, tokenizer, key, text, **options))
