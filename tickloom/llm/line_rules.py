"""Quality rules: counts within a text, and lines that too many documents of one host share.

Lines are normalised (A-Z lowered, digits as 0, white space as one blank) and hashed. A line stands above the limit in
a host if more than ``min_docs`` of its documents, and more than ``max_share`` of them, have it. Such lines are removed;
a document that loses more than ``max_loss`` of its words by that is depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.scan import BLANKS, LOWERED, Slice, mixed, slices, span_hashes, table, windows, words
from tickloom.llm.workers import ship, tidied
from tickloom.session import written

MIN_DOCS, MAX_SHARE, MAX_LOSS = 20, 0.1, 0.5
MIN_WORDS, MAX_REPEATED = 50, 0.5

_SYMBOLS = table(b"#*$%&|<>")
_BREAKS = table(b"\n")
_NORMAL = LOWERED.copy()
_NORMAL[list(b"123456789")] = ord("0")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many flags are set between successive borders."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[borders])


def _per_text(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, too."""
    return mixed(hashes + (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def text_counts(part: Slice) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text; owner, normalised hash and words of each different line of each text."""
    data, offsets = part.bytes, part.offsets
    found = words(data, offsets)
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), found.counts)

    lines = words(data, offsets, _BREAKS)
    first, end = np.searchsorted(found.starts, lines.starts), np.searchsorted(found.starts, lines.ends)
    filled = end > first
    first, end = first[filled], end[filled]
    line_owner = np.repeat(np.arange(texts), lines.counts)[filled]
    _, once = np.unique(_per_text(line_owner, lines.hashes[filled]), return_index=True)

    hashes, fits = windows(found, 3)
    _, which, times = np.unique(_per_text(owner, hashes), return_inverse=True, return_counts=True)
    # Windows beyond a text's end count on their own: none may repeat one that fits.
    times = np.bincount(which[fits], minlength=len(times))
    repeated = fits & (times[which] > 1)
    covered = repeated.copy()
    covered[1:] |= repeated[:-1]
    covered[2:] |= repeated[:-2]

    counts = {
        "n_words": found.counts,
        "word_chars": _sums(~BLANKS[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_owner, minlength=texts) - np.bincount(line_owner[once], minlength=texts),
        "n_repeat_words": _sums(covered, found.first),
    }
    normal = span_hashes(_NORMAL[data].astype(np.uint64) + np.uint64(1), found.starts, found.ends) | np.uint64(1)
    line_hashes = span_hashes(normal, first, end)
    _, at, which = np.unique(_per_text(line_owner, line_hashes), return_index=True, return_inverse=True)
    line_words = np.bincount(which, weights=end - first, minlength=len(at)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return counts, line_owner[at][order], line_hashes[at][order], line_words[order]


def _lists(owner: np.ndarray, values: np.ndarray, texts: int) -> pa.ListArray:
    borders = np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(values))


def scanned_lines(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Per row ``key, host``, the counts, and ``line_hashes`` with ``line_words`` of its different lines."""
    ship(df.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, owner, hashes, sizes = text_counts(part)
                texts = len(part.offsets) - 1
                columns = [part.rows.column(0), part.rows.column(1)]
                columns += [pa.array(counts[name].astype(np.int64)) for name in _COUNTS]
                columns += [_lists(owner, hashes.view(np.int64), texts), _lists(owner, sizes, texts)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "host", *_COUNTS, "line_hashes", "line_words"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("host", T.StringType())])
    for name in _COUNTS:
        schema = schema.add(name, T.LongType())
    for name in ("line_hashes", "line_words"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    named = df.select(df[key].alias("key"), F.coalesce(df[host].cast("string"), F.lit("")).alias("host"), df[text].alias("text"))
    return named.mapInArrow(tidied(scan), schema)


def frequent_lines(scanned: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``host, line_hash`` of the lines above the limit; counted inside each task before the shuffle.

    A line counts once for each different key, whatever rows the key has; rows without a key count for none. Where no key
    repeats, rows are keys and need not be told apart.
    """
    sizes = scanned.groupBy("host").agg(F.count("*").alias("documents"))
    lines = scanned.filter("key is not null").select("host", "key", F.explode("line_hashes").alias("line_hash"))
    repeats = not scanned.groupBy("key").agg(F.count("*").alias("n")).filter("key is not null and n > 1").isEmpty()
    counted = F.count_distinct("key") if repeats else F.count("*")
    often = lines.groupBy("host", "line_hash").agg(counted.alias("n")).filter(F.col("n") > min_docs)
    return often.join(sizes, "host").filter(F.col("n") > F.col("documents") * max_share).select("host", "line_hash")


def quality_rules(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    max_loss: float = MAX_LOSS,
) -> DataFrame:
    """Per row: key, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows. ``kept`` is false for
    those and for depleted documents. Null and empty texts have no words and fail. Each row is judged by its own text; for
    the limit ``min_docs`` a line counts once per key, and rows with a null key not at all, while the share is that of the
    host's rows. Rows without a host form one host. A document counts once for a line it repeats. Other columns are not read.
    """
    scanned = written(scanned_lines(df, key, text, host).withColumn("row", F.monotonically_increasing_id()), "lines")
    frequent = frequent_lines(scanned, min_docs, max_share)
    pairs = F.explode(F.arrays_zip("line_hashes", "line_words")).alias("line")
    lines = scanned.select("row", "host", pairs).select("row", "host", "line.line_hashes", "line.line_words")
    lines = lines.withColumnRenamed("line_hashes", "line_hash")
    removed = lines.join(frequent, ["host", "line_hash"]).groupBy("row").agg(F.sum("line_words").alias("n_removed_words"))
    judged = scanned.drop("line_hashes", "line_words").join(removed, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * MAX_REPEATED)
    lost = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    return judged.select(
        F.col("key").alias(key),
        *_COUNTS,
        failed.alias("base_failed"),
        lost.alias("n_removed_words"),
        (~failed & (lost <= F.col("n_words") * max_loss)).alias("kept"),
    )


def without_frequent_lines(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """``key, text`` of every row with the lines above the limit taken out; a null text stays null.

    The lines left keep their order and text, joined by line breaks.
    """
    ship(df.sparkSession)
    named = df.select(df[key].alias("key"), F.coalesce(df[host].cast("string"), F.lit("")).alias("host"), df[text].alias("text"))
    rows = written(named.withColumn("row", F.monotonically_increasing_id()), "texts")
    # The key of the scan is the row here, so that rows with equal keys stay apart; for the counts it is the key again.
    scanned = written(scanned_lines(rows, "row", "text", "host"), "lines")
    lines = scanned.select(F.col("key").alias("row"), "host", F.explode("line_hashes").alias("line_hash"))
    keyed = scanned.withColumnRenamed("key", "row").join(rows.select("row", "key"), "row")
    unwanted = lines.join(frequent_lines(keyed, min_docs, max_share), ["host", "line_hash"])
    unwanted = unwanted.groupBy("row").agg(F.collect_list("line_hash").alias("unwanted"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cleaned = [None if old is None else _stripped(old, drop) for old, drop in zip(*map(pa.Array.to_pylist, part.rows.columns[1:]))]
                yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(cleaned, pa.string())], ["key", "text"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("text", T.StringType())])
    joined = rows.join(unwanted, "row", "left").select("key", "text", "unwanted")
    return joined.mapInArrow(tidied(strip), schema).withColumnsRenamed({"key": key, "text": text})


def _stripped(old: str, drop: list[int] | None) -> str:
    if not drop:
        return old
    unwanted = set(drop)
    return "\n".join(line for line in old.split("\n") if line_hash(line) not in unwanted)


def line_hash(line: str) -> int | None:
    """Normalised hash of one line as in ``line_hashes``; None for a line without words."""
    data = _NORMAL[np.frombuffer(line.encode(), np.uint8)]
    found = words(data, np.array([0, len(data)]))
    if not len(found.hashes):
        return None
    ends = np.array([len(found.hashes)])
    return int(span_hashes(found.hashes | np.uint64(1), np.zeros(1, int), ends).view(np.int64)[0])
