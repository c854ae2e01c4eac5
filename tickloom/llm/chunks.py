"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest over all documents.

The gear hash adds a value per byte and shifts by one bit, so it depends on the last 32 bytes only. A chunk ends after
a word at whose last byte the hash is small: one word in eight. In a stretch of more than 16 words without such a place
words with a somewhat larger hash end chunks too, and after 256 words a chunk ends anyway. Cuts follow from the text
around them, so an insertion moves none but the nearest ones. Of a chunk that several documents have, the document with
the smallest key keeps it; within a document the first place does. Other places are removed where they stand in a
run of at least ``min_words`` words, so that single phrases stay. A run counts whole chunks only: the words of a passage
before its first and after its last cut, about a quarter of one of 51 words, are not in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.scan import Slice, mixed, slices, span_hashes, words
from tickloom.llm.workers import ship, tidied
from tickloom.operators.segments import free_name
from tickloom.session import written

#: Words of whole chunks. With 24, one in a hundred passages of 51 words has too short a run.
MIN_WORDS = 16
_FIRST, _SECOND, _STRETCH, _LONGEST = (1 << 32) // 8, (1 << 32) // 8 + (1 << 32) // 4, 16, 256
_WINDOW = 32
_SPAN = 1 << 10
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _doubled(values: np.ndarray) -> np.ndarray:
    """Gear hash along the last axis: every value plus those before it, shifted by their distance."""
    step = 1
    while step < _WINDOW:
        shifted = values[..., :-step] << np.uint32(step)
        values = values.copy()
        values[..., step:] += shifted
        step *= 2
    return values


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gear hash at every byte, from the bytes of its own text only."""
    if not len(data):
        return np.empty(0, np.uint32)
    hashes = _doubled(_GEAR[data])
    # At a text's start the window would reach into the text before.
    near = offsets[:-1, None] + np.arange(_WINDOW - 1)
    inside = near < offsets[1:, None]
    at = np.minimum(near, len(data) - 1)
    hashes[at[inside]] = _doubled(np.where(inside, _GEAR[data[at]], np.uint32(0)))[inside]
    return hashes


def chunk(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word (within its text), words and digest of each chunk, and the words of each text."""
    found = words(part.bytes, part.offsets)
    count = len(found.starts)
    texts = len(part.offsets) - 1
    if not count:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), found.counts
    hashes = gear_hashes(part.bytes, part.offsets)[found.ends - 1]
    last = hashes < _FIRST
    last[found.first[1:][found.counts > 0] - 1] = True
    for limit, extra in ((_STRETCH, hashes < _SECOND), (_LONGEST, None)):
        number = np.cumsum(last) - last
        begins = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        sizes = np.diff(np.append(begins, count))
        if extra is None:
            extra = (np.arange(count) - begins[number]) % limit == limit - 1
        last |= extra & (sizes[number] > limit)
    begins = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    ends = np.append(begins[1:], count)
    owner = np.repeat(np.arange(texts), found.counts)[begins]
    digests = span_hashes(found.hashes | np.uint64(1), begins, ends)
    return owner, begins - found.first[owner], ends - begins, digests, found.counts


def chunked(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row ``key, row, n_words, digests, spans, again``.

    ``row`` tells rows of one key apart by their text. A span is a chunk's first word times 1024 plus its words;
    ``again`` holds the spans of chunks that stand earlier in the same text and have no place in ``digests``.
    """
    ship(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, first, size, digests, n_words = chunk(part)
                spans = first * _SPAN + size
                own = mixed(digests + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                _, at = np.unique(own, return_index=True)
                once = np.zeros(len(owner), bool)
                once[at] = True
                texts = np.arange(len(n_words) + 1)
                lists = []
                for chosen, values in ((once, digests.view(np.int64)), (once, spans), (~once, spans)):
                    borders = np.searchsorted(owner[chosen], texts).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(borders), pa.array(values[chosen], pa.int64())))
                columns = [*part.rows.columns[:2], pa.array(n_words.astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "n_words", "digests", "spans", "again"])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("row", T.LongType())])
    schema = schema.add("n_words", T.LongType()).add("digests", longs).add("spans", longs).add("again", longs)
    return _named(df, key, text).mapInArrow(tidied(cut), schema)


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[key].alias("key"), F.xxhash64(df[key], df[text]).alias("row"), df[text].alias("text"))


def _runs(spans: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first word, end) of the runs of adjacent spans that are long enough."""
    runs: list[list[int]] = []
    for span in sorted(set(spans)):
        begin, size = divmod(span, _SPAN)
        if runs and runs[-1][1] == begin:
            runs[-1][1] += size
        else:
            runs.append([begin, begin + size])
    return [(begin, end) for begin, end in runs if end - begin >= min_words]


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``key, row, n_words, n_chunks`` of all rows, and ``key, row, runs`` of those with something to remove.

    ``runs`` are pairs of first word and end. Digests are reduced to their smallest and largest key inside each task
    before the shuffle; places of repeated digests are found by a join that adaptive execution can split, and meet again
    only by row. Rows that share a key keep what they share; rows with a null key lose only what they repeat
    themselves.
    """
    cut = written(chunked(df, key, text), "chunks")
    digests = cut.select("key", F.explode("digests").alias("digest"))
    ends = digests.groupBy("digest").agg(F.min("key").alias("keeper"), F.max("key").alias("last"))
    repeated = ends.filter(F.col("keeper") != F.col("last")).select("digest", "keeper")
    pairs = cut.select("key", "row", F.explode(F.arrays_zip("digests", "spans")).alias("place"))
    places = pairs.select("key", "row", F.col("place.digests").alias("digest"), F.col("place.spans").alias("span"))
    others = places.join(repeated, "digest").filter(F.col("key") != F.col("keeper"))
    again = cut.select("key", "row", F.explode("again").alias("span"))
    collected = others.select("key", "row", "span").union(again).groupBy("key", "row").agg(F.collect_set("span").alias("spans"))

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            runs = [[{"first": a, "end": b} for a, b in _runs(spans, min_words)] for spans in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(runs, kind)], ["key", "row", "runs"])

    run = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*collected.schema.fields[:2], T.StructField("runs", T.ArrayType(run))])
    runs = collected.mapInArrow(tidied(join_runs), schema).filter(F.size("runs") > 0)
    counts = cut.select("key", "row", "n_words", (F.size("digests") + F.size("again")).cast("long").alias("n_chunks"))
    return counts, runs


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: key, ``n_words, n_chunks, n_removed_words`` and ``removed``, the runs of words that stand elsewhere first.

    Null and empty texts have no words and nothing to remove. Every input row gives one row. Other columns are not read.
    """
    counts, runs = repeated_spans(df, key, text, min_words)
    unique = runs.dropDuplicates(["key", "row"]).withColumnRenamed("key", "other")
    joined = counts.join(unique, (counts["row"] == unique["row"]) & counts["key"].eqNullSafe(unique["other"]), "left")
    lost = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"]), F.lit(0).cast("long"))
    return joined.select(
        counts["key"].alias(key), "n_words", "n_chunks", lost.alias("n_removed_words"), F.coalesce("runs", F.array()).alias("removed")
    )


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with repeated passages taken out of the text, all other columns as they are.

    A passage goes from its first word up to the next word that stays. A null text stays null.
    """
    _, runs = repeated_spans(df, key, text, min_words)
    columns = df.columns
    names = {name: free_name(df, f"of_{name}") for name in ("key", "row", "runs")}
    runs, own = runs.withColumnsRenamed(names), free_name(df, "own")
    marked = df.withColumn(own, F.xxhash64(key, text))
    joined = marked.join(runs, (F.col(own) == F.col(names["row"])) & F.col(key).eqNullSafe(F.col(names["key"])), "left")
    at = columns.index(text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = words(part.bytes, part.offsets, hashed=False)
                olds, runs_of = part.rows.column(at).to_pylist(), part.rows.column(len(columns)).to_pylist()
                texts = [_stripped(old, i, runs, part, found) if runs else old for i, (old, runs) in enumerate(zip(olds, runs_of))]
                new = [*part.rows.columns[: len(columns)]]
                new[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(new, columns)

    return joined.select(*columns, names["runs"]).mapInArrow(tidied(strip), df.schema)


def _stripped(old: str | None, i: int, runs: list[dict], part: Slice, found) -> str | None:
    if old is None:
        return None
    raw, base = old.encode(), int(part.offsets[i])
    first, end = int(found.first[i]), int(found.first[i + 1])
    kept, at = [], 0
    for run in runs:
        kept.append(raw[at : int(found.starts[first + run["first"]]) - base])
        after = first + run["end"]
        at = int(found.starts[after]) - base if after < end else len(raw)
    return b"".join([*kept, raw[at:]]).decode()
