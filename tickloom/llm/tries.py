r"""Conversation prefix trie: every distinct beginning of a conversation as a node, with counts over its subtree.

Each turn gets a digest of all turns up to it. Tasks count the digests in count-min sketches, which are merged, handed
to every executor and mapped into memory. An estimate never lies below the true count, so a digest with estimate one
stands in one conversation only, and so do all longer beginnings of that conversation: those nodes are chains of one
conversation and are emitted where they stand. Only beginnings that may be shared are shuffled and grouped exactly; what
the sketch takes for shared by mistake is grouped with itself. The sketch is bounded in size: beyond that more
beginnings go the exact way, with the same result.

Sums over a subtree need no walk over the trie. A node belongs to its smallest conversation, its owner; the owner of a
node owns all longer beginnings of itself. So what lies in the subtree of a node is what its conversations own, less what
the node's owner owns above it: one sum over conversations, and one running sum along each owner.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.scan import mixed
from tickloom.llm.workers import hand_out, mapped, ship, tidied
from tickloom.operators.segments import Buckets
from tickloom.session import written

SKETCH_ROWS = 3
#: Cells of a sketch row, powers of two: about four for every beginning, within these bounds. A cell is a byte.
FEWEST_CELLS, MOST_CELLS = 1 << 10, 1 << 24
#: Counts above one need not be told apart.
MANY = 2
_BLOCK, _FAN_IN = 1 << 16, 32
IDS_PER_CHUNK = 1 << 14
_NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = ["g1", "g2", "place"]
_NUMBER = "decimal(38,0)"


def prefix_rows(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Per turn ``conv, place, g1, g2, p1, p2, n_bytes, is_last``: place from 1, digests of the turns up to it and before it.

    A turn's own digest is taken from the SHA-256 of its role and text; the digest of a beginning is the sum of two 64-bit hashes
    of place and turn digest, exact in decimals, so that it adds up over buckets of a long conversation.
    """
    said, who = F.coalesce(turns[text], F.lit("")), F.coalesce(turns[role], F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    part = lambda begin: F.conv(F.substring("digest", begin, 15), 16, 10).cast("long")
    named = turns.filter(turns[key].isNotNull()).select(
        turns[key].alias("conv"), turns[turn].alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes")
    )
    numbered = named.select("conv", "turn", part(1).alias("t1"), part(16).alias("t2"), "n_bytes", F.monotonically_increasing_id().alias("row"))
    numbered = written(numbered, "turns")
    buckets = Buckets(numbered, ["conv"], ["turn", "t1", "t2", "row"])
    placed = buckets.running(buckets.placed(numbered), {"place": ("sum", F.lit(1))})
    hashes = {f"h{k}": F.xxhash64(F.lit(k), "place", "t1", "t2").cast("decimal(20,0)") for k in (1, 2)}
    rolled = buckets.running(placed.withColumns(hashes), {"g1": ("sum", "h1"), "g2": ("sum", "h2")})
    rolled = buckets.previous(rolled, "place", "next", descending=True)
    sums = [F.col(f"g{k}").cast(_NUMBER).alias(f"g{k}") for k in (1, 2)]
    before = [(F.col(f"g{k}") - F.col(f"h{k}")).cast(_NUMBER).alias(f"p{k}") for k in (1, 2)]
    return rolled.select("conv", F.col("place").cast("long").alias("place"), *sums, *before, "n_bytes", F.col("next").isNull().alias("is_last"))


def cells_of(digests: np.ndarray, row: int, width: int) -> np.ndarray:
    salt = np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mixed(digests + salt) & np.uint64(width - 1)).astype(np.int64)


def counted(cells: np.ndarray, digests: np.ndarray) -> None:
    """Add the digests to a sketch; a count stops at ``MANY``."""
    for row in range(len(cells)):
        at, n = np.unique(cells_of(digests, row, cells.shape[1]), return_counts=True)
        cells[row, at] = np.minimum(cells[row, at].astype(np.int64) + n, MANY)


def estimates(cells: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return np.min([cells[row, cells_of(digests, row, cells.shape[1])] for row in range(len(cells))], axis=0)


def _digest64() -> Column:
    return F.xxhash64(*_NODE)


def sketch(rows: DataFrame, width: int) -> str:
    """Name of the handed-out count-min sketch of all beginnings: a sketch per task, merged block by block in rounds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((SKETCH_ROWS, width), np.uint8)
        for batch in batches:
            counted(cells, np.asarray(batch.column(0)).view(np.uint64))
        task = TaskContext.get().partitionId()
        flat = cells.reshape(-1)
        for number, begin in enumerate(range(0, len(flat), _BLOCK)):
            block = flat[begin : begin + _BLOCK]
            if block.any():
                packed = zlib.compress(block.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([number], pa.int64()), pa.array([packed], pa.binary())], names)

    def merge(blocks: pa.Table) -> pa.Table:
        total = None
        for packed in blocks.column("cells"):
            own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
            total = own if total is None else np.minimum(total + own, MANY)
        return pa.table([blocks.column("part")[:1], blocks.column("block")[:1], pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=names)

    names = ["part", "block", "cells"]
    schema = "part bigint, block bigint, cells binary"
    parts = written(rows.select(_digest64().alias("d")).mapInArrow(tidied(count), schema), "sketches")
    while (most := parts.agg(F.max("part")).first()[0]) is not None and most > 0:
        grouped = parts.withColumn("part", F.floor(F.col("part") / _FAN_IN)).groupBy("part", "block")
        parts = written(grouped.applyInArrow(merge, schema), "sketches")

    def blocks() -> Iterator[bytes]:
        at, size = 0, SKETCH_ROWS * width
        for row in parts.select("block", "cells").orderBy("block").toLocalIterator():
            begin = row.block * _BLOCK
            yield from _zeros(begin - at)
            block = zlib.decompress(row.cells)
            at = begin + len(block)
            yield block
        yield from _zeros(size - at)

    return hand_out(rows.sparkSession, "sketch", blocks())


def _zeros(count: int) -> Iterator[bytes]:
    while count > 0:
        yield bytes(min(count, _BLOCK))
        count -= _BLOCK


def screened(rows: DataFrame, name: str) -> DataFrame:
    """The rows with ``proven``, in one conversation only, and ``is_top``, proven right after a row that is not.

    Estimate one proves a beginning, and with it the longer ones that follow in the same stretch of rows.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = mapped(name, np.uint8).reshape(SKETCH_ROWS, -1)
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, place = (np.asarray(batch.column(k)) for k in (0, 1))
            alone = estimates(cells, np.asarray(batch.column(batch.num_columns - 1)).view(np.uint64)) == 1
            goes_on = np.zeros(len(conv), bool)
            goes_on[1:] = (conv[1:] == conv[:-1]) & (place[1:] == place[:-1] + 1)
            goes_on[0] = last is not None and last[:2] == (conv[0], place[0] - 1)
            at = np.arange(len(conv))
            begin = np.maximum.accumulate(np.where(goes_on, 0, at))
            nearest = np.maximum.accumulate(np.where(alone, at, -1))
            carried = bool(goes_on[0] and last[2])
            proven = (nearest >= begin) | (carried & (begin == 0))
            before = np.concatenate([[carried], proven[:-1] & goes_on[1:]])
            last = (conv[-1], place[-1], bool(proven[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(proven), pa.array(proven & ~before)], names)

    names = [*rows.columns, "proven", "is_top"]
    schema = T.StructType([*rows.schema.fields]).add("proven", T.BooleanType()).add("is_top", T.BooleanType())
    return rows.select("*", _digest64().alias("digest64")).mapInArrow(tidied(test), schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``g1, g2, place, ends_sha256`` from ``g1, g2, place, conv`` rows: the SHA-256 of the node's sorted, joined ids.

    The rows are sorted over all tasks and packed into texts of some thousand ids; a node's texts then meet in order and are
    hashed one after the other, so no list of a node is ever held as a whole.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            for *own, conv in zip(*[column.to_pylist() for column in batch.columns]):
                if own != node or len(ids) >= IDS_PER_CHUNK:
                    if ids:
                        yield chunk(node, ids)
                    node, ids = own, []
                ids.append(conv)
        if ids:
            yield chunk(node, ids)

    def chunk(node: list, ids: list[int]) -> pa.RecordBatch:
        values = [*node, ids[0], ",".join(map(str, ids))]
        return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(values, kinds)], [*_NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            for *own, _, ids in zip(*[column.to_pylist() for column in batch.columns]):
                if own == node:
                    running.update(b"," + ids.encode())
                    continue
                if node is not None:
                    yield result(node, running)
                node, running = own, hashlib.sha256(ids.encode())
        if node is not None:
            yield result(node, running)

    def result(node: list, running) -> pa.RecordBatch:
        values = [*node, running.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(values, [*kinds[:3], pa.string()])], [*_NODE, "ends_sha256"])

    kinds = [pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.string()]
    types = f"g1 {_NUMBER}, g2 {_NUMBER}, place bigint"
    sorted_ends = ends.select(*_NODE, "conv").repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    chunks = sorted_ends.mapInArrow(tidied(pack), f"{types}, first bigint, ids string")
    together = chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return together.mapInArrow(tidied(digest), f"{types}, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    conversations: DataFrame | None = None,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """Per node: key (its smallest conversation), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of the first ``depth`` turns (role, text); the root has none and every conversation is in it.
    ``n_leaves`` and ``saved_tokens`` are over the subtree, the node included: childless nodes, and ``(n_convs - 1)`` times the UTF-8
    bytes of the node's last text. ``ends_sha256``: of the ids of the conversations that end there, ascending, joined by commas.

    ``conversations`` (a column named as ``key``) adds ids that have no turns. Keys are whole numbers; rows without one are
    left out. Turns follow their number, null first; equal numbers are ordered by a digest of role and text, and rows that
    repeat are turns of their own. A null role or text is empty. No conversations give no rows. Other columns are not read.
    """
    ship(turns.sparkSession)
    spark = turns.sparkSession
    rows = written(prefix_rows(turns.withColumn(key, turns[key].cast("long")), key, turn, role, text), "prefixes")
    cells = min(most_cells, max(FEWEST_CELLS, 1 << (4 * rows.count()).bit_length()))
    rows = written(screened(rows, sketch(rows, cells)), "screened")
    proven, shared = rows.filter("proven"), rows.filter("not proven")
    tops = proven.filter("is_top")

    ended = rows.filter("is_last").select("conv")
    turnless = spark.createDataFrame([], ended.schema)
    if conversations is not None:
        every = conversations.select(conversations[key].cast("long").alias("conv")).filter("conv is not null").distinct()
        turnless = written(every.join(ended, "conv", "left_anti"), "turnless")

    groups = shared.groupBy(*_NODE).agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    nodes = written(groups.withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    above = [F.col("p1").alias("g1"), F.col("p2").alias("g2"), (F.col("place") - 1).alias("place")]
    kids = nodes.select(*above).unionAll(tops.select(*above)).groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    kids = written(kids, "children")

    # What each conversation owns: the weights of its nodes, and the leaf it may end in.
    childless = nodes.join(kids, _NODE, "left_anti").select(F.col("owner").alias("conv"), F.lit(0).cast("long").alias("own"), F.lit(1).alias("leaf"))
    weights = nodes.select(F.col("owner").alias("conv"), "own", F.lit(0).alias("leaf"))
    single = proven.filter("is_last").select("conv", F.lit(0).cast("long").alias("own"), F.lit(1).alias("leaf"))
    owned = weights.unionAll(childless).unionAll(single).groupBy("conv").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaves"))
    owned = written(owned, "owned")
    within = shared.select("conv", *_NODE).join(owned, "conv").groupBy(*_NODE).agg(F.sum("own").alias("all_own"), F.sum("leaves").alias("n_leaves"))

    buckets = Buckets(nodes, ["owner"], ["place"])
    along = buckets.plain(buckets.running(buckets.placed(nodes), {"so_far": ("sum", "own")}))
    zero = F.lit(0).cast(_NUMBER)
    root_ends = turnless.select(zero.alias("g1"), zero.alias("g2"), F.lit(0).cast("long").alias("place"), "conv")
    ends = written(ends_digests(shared.filter("is_last").select(*_NODE, "conv").unionAll(root_ends)), "ends")

    full = along.join(within, _NODE).join(kids, _NODE, "left").join(ends, _NODE, "left")
    exact = full.select(
        *_NODE, "p1", "p2", "owner", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("all_own") - F.col("so_far") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long")
    alone = [
        F.col("conv").alias("owner"), one.alias("n_convs"), (one - F.col("is_last").cast("long")).alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("is_last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    ]
    hanging = exact.unionAll(tops.select(*_NODE, "p1", "p2", *alone))
    parents = nodes.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), (F.col("place") + 1).alias("place"), F.col("owner").alias("parent"))
    deeper = hanging.filter("place > 1").join(parents, ["p1", "p2", "place"], "left").withColumn("parent", F.coalesce("parent", "owner"))

    counts = ended.unionAll(turnless).agg(F.count("*").alias("n"), F.min("conv").alias("least")).first()
    first = hanging.filter("place = 1").withColumn("parent", F.lit(counts.least).cast("long"))
    following = proven.filter("not is_top").select("place", *alone).withColumn("parent", F.col("owner"))
    columns = ["owner", "place", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = deeper.select(*columns).unionAll(first.select(*columns)).unionAll(following.select(*columns))
    if counts.n:
        sums = owned.agg(F.sum("own").alias("own"), F.sum("leaves").alias("leaves")).first()
        children = kids.filter("place = 0").agg(F.sum("n_children")).first()[0] or 0
        at_root = ends.filter("place = 0").select("ends_sha256").first()
        root = (counts.least, 0, None, counts.n, children, sums.leaves or 1, sums.own or 0, at_root[0] if at_root else _NOTHING)
        found = found.unionAll(spark.createDataFrame([root], found.schema))
    return found.select(
        F.col("owner").alias(key), F.col("place").alias("depth"), F.col("parent").alias("parent_conv_id"), *columns[3:]
    )


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, turn, role, text`` of the rebuilt conversations, and the ``conv_id`` of all, also of those left without turns.

    Of conversation c - c % 5 the first h turns, then its own after the first h, for h = crc32 of its decimal id, modulo 9. Turns
    follow their number, null first, then role and text. Rows without an id are left out.
    """
    empty = lambda name: F.coalesce(name, F.lit("")).alias(name)
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", empty("role"), empty("text"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "turns")
    buckets = Buckets(rows, ["conv_id"], ["turn", "role", "text", "row"])
    placed = buckets.plain(buckets.running(buckets.placed(rows), {"place": ("sum", F.lit(1))}))
    placed = written(placed.select("conv_id", "place", "role", "text"), "placed")
    taken = F.crc32(F.col("conv_id").cast("string")) % 9
    ids = placed.filter("place = 1").select("conv_id")
    bases = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), taken.alias("taken")).filter("taken > 0")
    heads = placed.filter((F.col("place") <= 8) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    before = bases.join(heads, "base").filter("place <= taken").select("conv_id", "place", "role", "text")
    own = placed.filter(F.col("place") > taken)
    return before.unionAll(own).withColumnRenamed("place", "turn"), ids
