"""Near-duplicates by MinHash: banded candidates, sequential Bayesian pruning, exact verification, components.

Texts with equal shingle sets form a class; only one representative of each goes on. Candidates are found in two
rounds. The first pairs the members of a band bucket with its smallest member, so a group of near copies of any size
gives one pair per member. The second looks into the buckets whose other members still lie in several components:
those outside the component of the smallest one meet all others in blocks, inside Arrow functions, are pruned and
verified there, and only links that join components leave the block. So no bucket is expanded into its pairs, and no
link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.components import components
from tickloom.llm.scan import LOWERED, mixed, shingle_sets, slices, words
from tickloom.llm.workers import ship, tidied
from tickloom.session import broadcast_if_small, written

ROWS_PER_BAND = 4
MISS_PROBABILITY = 1e-6
CHECK_EVERY = 16
#: Most members and shingles, about, of one side of a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
MAX_BROADCAST_IDS = 1_000_000
_CHUNK = 1 << 12


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS_PROBABILITY) -> int:
    """Bands needed so that a pair at the threshold shares none with at most probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(size: int, threshold: float, miss: float = MISS_PROBABILITY) -> int:
    """Fewest matches among ``size`` hashes at which a similarity at or above the threshold has posterior >= ``miss``.

    With a uniform prior the posterior of the similarity after m matches is Beta(m + 1, size - m + 1); its mass above
    the threshold equals the probability of at most m successes in size + 1 draws at the threshold.
    """
    mass = 0.0
    for m in range(size + 1):
        mass += math.comb(size + 1, m) * threshold**m * (1 - threshold) ** (size + 1 - m)
        if mass >= miss:
            return m
    return size


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the permutations; the same on every machine."""
    drawn = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (drawn[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[count:] >> np.uint64(32)).astype(np.uint32)


def signature(members: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least value of every permutation over a set of 64-bit hashes; sets of any size in bounded memory."""
    multipliers, offsets = family
    low = (members >> np.uint64(32)).astype(np.uint32) ^ members.astype(np.uint32)
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), _CHUNK):
        values = low[begin : begin + _CHUNK, None] * multipliers + offsets
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def sketches(df: DataFrame, key: str, text: str, size: int, hashes: int) -> DataFrame:
    """Per row: ``key, n_shingles``, a 128-bit digest of the set in two longs, and its packed signature."""
    ship(df.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(hashes)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, digests, packed = [], [], []
                for members in shingle_sets(words(LOWERED[part.bytes], part.offsets), size):
                    counts.append(len(members))
                    digests.append((mixed(members).sum(), mixed(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()))
                    packed.append(signature(members, family).tobytes() if len(members) else None)
                parts = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
                columns = [part.rows.column(0), pa.array(counts, pa.int64()), pa.array(parts[:, 0]), pa.array(parts[:, 1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["key", "n_shingles", "d1", "d2", "signature"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType)])
    for name in ("n_shingles", "d1", "d2"):
        schema = schema.add(name, T.LongType())
    named = df.select(df[key].alias("key"), df[text].alias("text"))
    return named.mapInArrow(tidied(sketch), schema.add("signature", T.BinaryType()))


def with_sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Per row ``key`` and the packed sorted shingle hashes of its whole text."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [members.tobytes() for members in shingle_sets(words(LOWERED[part.bytes], part.offsets), size)]
                yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(sets, pa.binary())], ["key", "shingles"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("shingles", T.BinaryType())])
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(tidied(collect), schema)


def band_keys(sketched: DataFrame, bands: int, rows: int = ROWS_PER_BAND) -> DataFrame:
    """``key, no, band`` for every band of every signature; the band's number ``no`` is part of the hash ``band``."""
    width = rows * 4
    parts = [F.xxhash64(F.lit(b), F.substring("signature", 1 + b * width, width)) for b in range(bands)]
    return sketched.select("key", F.posexplode(F.array(*parts)).alias("no", "band"))


def _survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Rows of two signature matrices that no stage of the sequential test prunes."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for begin in range(0, left.shape[1], CHECK_EVERY):
        end = min(begin + CHECK_EVERY, left.shape[1])
        matches = matches + (left[alive, begin:end] == right[alive, begin:end]).sum(axis=1)
        passed = matches >= least_matches(end, threshold, miss)
        alive, matches = alive[passed], matches[passed]
    return alive


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def pruned(pairs: DataFrame, sketched: DataFrame, threshold: float, hashes: int, miss: float) -> DataFrame:
    """Candidate pairs ``a, b`` whose signatures do not rule out a similarity at or above the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = _survivors(_matrix(batch.column(2), hashes), _matrix(batch.column(3), hashes), threshold, miss)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    side = sketched.select("key", "signature")
    both = pairs.join(side.withColumnsRenamed({"key": "b", "signature": "sb"}), "b")
    both = both.join(side.withColumnsRenamed({"key": "a", "signature": "sa"}), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(tidied(test), both.select("a", "b").schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have ``100 * shared >= percent * union``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            last, left = None, np.empty(0, np.uint64)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                packed = a.as_buffer()
                if last is None or not packed.equals(last):
                    last, left = packed, np.frombuffer(packed, np.uint64)
                right = np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                    continue
                # Merged stably, equal neighbours are the shared members.
                merged = np.sort(np.concatenate([left, right]), kind="stable")
                shared = int((merged[1:] == merged[:-1]).sum())
                if 100 * shared >= percent * (len(left) + len(right) - shared):
                    linked.append(i)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    both = pairs.join(sets.withColumnsRenamed({"key": "b", "shingles": "sb"}), "b")
    both = both.join(sets.withColumnsRenamed({"key": "a", "shingles": "sa"}), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(tidied(compare), both.select("a", "b").schema)


def _block_links(members: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int, hashes: int, rows: int, miss: float) -> DataFrame:
    """Second round: confirmed links between components from ``band, no, key, component, minor`` rows.

    ``minor`` members are those outside the component of the bucket's smallest member. Every minor one meets every
    member of another component: both sides are cut into blocks by hash, bounded in members and in shingles, and each
    block of minor members is sent to each block of all, with signatures and full sets. A pair is tested in the first
    band it shares. What the signatures do not rule out is checked exactly at once; of the links found in a block only
    those leave it that join components not yet joined there, fewer than it has members.
    """
    sized = members.join(sketched.select("key", "n_shingles", "signature"), "key")
    load = lambda n, words: F.ceil(F.greatest(n / BLOCK, words / BLOCK_SHINGLES)).cast("int")
    minor_words = F.sum(F.when(F.col("minor"), F.col("n_shingles")).otherwise(0))
    blocks = sized.groupBy("band").agg(
        load(F.count("*"), F.sum("n_shingles")).alias("all_blocks"), load(F.count_if("minor"), minor_words).alias("minor_blocks")
    )
    # One row per bucket that holds several components; in a plain join a hot bucket is split, as nothing else hangs on it.
    blocks = broadcast_if_small(written(blocks, "blocks"), MAX_BROADCAST_IDS)
    whole = sized.drop("n_shingles").join(sets, "key").join(blocks, "band")
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = ["no", "key", "component", "minor", "signature", "shingles"]
    left = whole.filter("minor").select("band", own("minor_blocks").alias("x"), each("all_blocks").alias("y"), F.lit(True).alias("is_left"), *carried)
    right = whole.select("band", each("minor_blocks").alias("x"), own("all_blocks").alias("y"), F.lit(False).alias("is_left"), *carried)

    def meet(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        is_left, minor = (np.asarray(block.column(name)) for name in ("is_left", "minor"))
        keys, component = block.column("key").combine_chunks(), np.asarray(block.column("component"))
        order = np.argsort(np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        signatures = _matrix(block.column("signature"), hashes)
        banded = signatures.reshape(len(signatures), -1, rows)
        shingles = [np.frombuffer(value.as_buffer(), np.uint64) for value in block.column("shingles")]
        lengths = np.array([len(own) for own in shingles])
        number, rights = block.column("no")[0].as_py(), np.flatnonzero(~is_left)
        root: dict = {}
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(is_left).tolist():
            others = rights[(component[rights] != component[i]) & (~minor[rights] | (order[rights] > order[i]))]
            others = others[(banded[others] == banded[i]).all(axis=2).argmax(axis=1) == number]
            same = np.broadcast_to(signatures[i], (len(others), hashes))
            others = others[_survivors(same, signatures[others], percent / 100, miss)]
            for j in others[_similar(shingles[i], [shingles[j] for j in others], lengths[others], percent)].tolist():
                a, b = _root(root, component[i]), _root(root, component[j])
                if a != b:
                    root[a] = b
                    found.append((i, j))
        first, second = (pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": keys.take(first), "b": keys.take(second)})

    kind = members.schema["key"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    # The union is dealt by band, which would do for the grouping, but leaves all blocks of a bucket in one task.
    return left.union(right).repartition("band", "x", "y").groupBy("band", "x", "y").applyInArrow(meet, schema)


def _root(root: dict, node):
    while node in root:
        node = root[node]
    return node


def _similar(own: np.ndarray, others: list[np.ndarray], lengths: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sorted sets share enough with ``own``: ``100 * shared >= percent * union``."""
    if not others:
        return np.empty(0, np.int64)
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
    shared = np.add.reduceat(own[at] == joined, np.cumsum(lengths) - lengths, dtype=np.int64)
    return np.flatnonzero(100 * shared >= percent * (len(own) + lengths - shared))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    rows: int = ROWS_PER_BAND,
    miss: float = MISS_PROBABILITY,
) -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id`` (smallest key reachable over links) and ``kept`` (it is that key).

    Two texts are linked if their sets of ``size``-word shingles (A-Z lowered) have
    ``100 * intersection >= percent * union``. A pair at the threshold is overlooked with probability ``miss`` for the
    bands and as much for each pruning step; links are confirmed on the full sets (of 64-bit shingle hashes). Null and
    empty texts have an empty set and are linked with nothing. Rows that share a key are each judged by
    their own text, and equal sets under one key are compared once; rows with a null key take part in nothing, are
    their own and are kept. Other columns are not read.
    """
    threshold = percent / 100
    bands = bands_for(threshold, rows, miss)
    hashes = bands * rows
    sketched = written(sketches(df, key, text, size, hashes), "sketches")
    filled = sketched.filter((F.col("n_shingles") > 0) & F.col("key").isNotNull())
    # Rows of one class have one signature, so an aggregate that combines before its shuffle finds all that is needed.
    alike = filled.groupBy("d1", "d2").agg(F.min("key").alias("key"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    signed = written(alike, "signatures")
    classes = signed.select("d1", "d2", "key")
    repeated = written(filled.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated")
    banded = band_keys(signed, bands, rows)
    hubs = banded.groupBy("band").agg(F.min("key").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a")
    buckets = written(banded.join(hubs, "band").select("band", "no", F.col("a").alias("hub"), "key"), "buckets")

    stars = buckets.filter(F.col("key") != F.col("hub")).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    first = written(pruned(stars, signed, threshold, hashes, miss), "survivors")
    pairs = first.select(F.col("a").alias("key")).union(first.select(F.col("b").alias("key"))).distinct()
    links = written(verified(first, _sets_of(df, pairs, repeated, key, text, size), percent), "confirmed")

    labels = components(links)
    named = lambda node: F.coalesce(node, F.col("key"))
    members = buckets.join(labels.withColumnsRenamed({"node": "key", "component": "own"}), "key", "left")
    members = members.join(labels.withColumnsRenamed({"node": "hub", "component": "of_hub"}), "hub", "left")
    members = members.filter(F.col("key") != F.col("hub")).select(
        "band", "no", "key", named(F.col("own")).alias("component"), (named(F.col("own")) != F.coalesce("of_hub", "hub")).alias("minor")
    )
    members = written(members.distinct(), "members")
    spread = members.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.bool_or("minor").alias("any"))
    several = spread.filter((F.col("least") != F.col("most")) & F.col("any")).select("band")
    rest = written(members.join(several, "band", "left_semi"), "rest")
    if rest.isEmpty():
        final = labels
    else:
        sets = _sets_of(df, rest.select("key").distinct(), repeated, key, text, size)
        more = written(_block_links(rest, sets, signed, percent, hashes, rows, miss), "confirmed")
        final = labels if more.isEmpty() else components(links.union(more))

    named_classes = classes.withColumnRenamed("key", "representative")
    joined = sketched.drop("signature").join(named_classes, ["d1", "d2"], "left")
    node = F.when(F.col("n_shingles") > 0, F.col("representative"))
    joined = joined.withColumn("node", node).join(final, "node", "left")
    component = F.coalesce("component", "node", "key")
    result = joined.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))
    own = F.col(key).isNull() | (F.col(key) == F.col("component_id"))
    return result.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"), own.alias("kept"))


def _sets_of(df: DataFrame, keys: DataFrame, repeated: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Shingle sets of the documents with the given keys, one row per key and set; only their texts are read again."""
    wanted = written(keys.withColumnRenamed("key", key), "wanted")
    texts = df.select(df[key], df[text]).join(broadcast_if_small(wanted, MAX_BROADCAST_IDS), key, "left_semi")
    sets = written(with_sets(texts, key, text, size), "sets")
    if repeated.isEmpty():
        return sets
    several = broadcast_if_small(repeated, MAX_BROADCAST_IDS)
    once = sets.join(several, "key", "left_semi").distinct()
    return written(sets.join(several, "key", "left_anti").union(once), "sets")
