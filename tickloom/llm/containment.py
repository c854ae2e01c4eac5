r"""Benchmark decontamination: short items inside long documents by MinHash over partitions of size.

Built of DataFrame and SQL functions only. Texts are lower-cased and cut at everything that is no letter or digit;
their members are hashes of ``size`` consecutive words. MinHash with one permutation: the 64-bit hashes are dealt to
2**m bins by their top bits, and the least hash of each bin is the signature. Items are partitioned by size, in classes
by powers of two, and each class has its own load, the members of a document that a bin may hold on average: so many that
of the members an item must share, all are overlooked with at most a given probability. A long item has many, so several
members to a bin do; a short one needs more bins than the document has members. The load partitions the documents by
size, as m is the least number of bits that keeps to it; where that gives more bins than needed, a part of the signature,
chosen by the low bits of the hashes, will do. Documents are signed as finely as the shortest class asks; a longer class
takes those members that are least in its wider bins, as every bin lies within the bins of a coarser partition.
Candidates are confirmed by exact containment of the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import written

SIZE, THRESHOLD, MISS_PROBABILITY = 5, 0.8, 1e-6
MAX_BROADCAST_MEMBERS = 1_000_000
_PARTS = 1 << 12


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_members(df: DataFrame, size: int = SIZE) -> DataFrame:
    """Replace ``text`` by ``members``, the sorted distinct hashes of its word windows.

    A text with fewer than ``size`` words has one member, its whole sequence; one without words has none.
    """
    rest = ", ".join(f"get(words, i + {k})" for k in range(1, size))
    window = f"transform(words, (w, i) -> xxhash64(w{', ' + rest if rest else ''}))"
    kept = f"slice({window}, 1, greatest(size(words) - {size - 1}, 1))"
    cut = df.withColumn("words", _words(F.col("text"))).drop("text")
    return cut.withColumn("members", F.expr(f"sort_array(array_distinct({kept}))")).drop("words")


def _least_from(member: str, before: str) -> Column:
    """Number of bits from on which ``member`` is the least of its bin, given the next smaller member (null: none)."""
    shared = 64 - F.length(F.bin(F.col(member).bitwiseXOR(F.col(before))))
    return F.when(F.col(before).isNull(), 1).otherwise(shared + 1)


def item_signatures(items: DataFrame) -> DataFrame:
    """``item, member, class, item_bits``: the member is the least of its bin, among the item's, from that many bits on."""
    each = items.select("item", "class", "members", F.posexplode("members").alias("i", "member"))
    placed = each.withColumn("before", F.expr("get(members, i - 1)"))
    return placed.select("item", "member", "class", _least_from("member", "before").alias("item_bits"))


def document_signatures(docs: DataFrame, loads: Sequence[float], threshold: float = THRESHOLD) -> DataFrame:
    """``doc, n_members, member, before`` for all classes of items: least members of bins, and the next smaller member.

    The bins are those of the smallest load, and of their least members as many are taken as the class that needs most.
    """
    size = F.col("n_members")
    part = F.greatest(F.lit(0), F.lit(0), *[part_taken(size, F.lit(load), threshold) for load in loads])
    binned = docs.withColumn("n_members", F.greatest(F.size("members"), F.lit(1)))
    binned = binned.withColumns({"bits": partition_bits(size, F.lit(min(loads, default=1.0))), "part": part})
    pairs = "transform(members, (x, i) -> named_struct('member', x, 'before', get(members, i - 1)))"
    least = (
        f"filter({pairs}, p -> (p.member & {_PARTS - 1}) < part AND"
        " (p.before IS NULL OR shiftrightunsigned(p.member, 64 - bits) <> shiftrightunsigned(p.before, 64 - bits)))"
    )
    return binned.select("doc", "n_members", F.explode(F.expr(least)).alias("p")).select("doc", "n_members", "p.member", "p.before")


def part_taken(members: Column, load: Column, threshold: float) -> Column:
    """How many of ``_PARTS`` values of the low bits make up the part of a signature that is needed."""
    share = lambda full: (1 - F.exp(-full)) / full
    actual = members / threshold / F.pow(F.lit(2.0), partition_bits(members, load))
    return F.least(F.lit(_PARTS), F.ceil(share(load / threshold) / share(actual) * _PARTS)).cast("int")


def partition_bits(members: Column, load: Column) -> Column:
    """Fewest bits whose bins hold at most ``load`` of so many members on average."""
    return F.least(F.lit(62), F.greatest(F.lit(1), F.ceil(F.log2(members / load)).cast("int")))


def least_share(load: float) -> float:
    """Probability that a member is the least of its bin, where bins hold ``load`` members on average, at random."""
    return -math.expm1(-load) / load


def load_for(fewest: int, threshold: float = THRESHOLD, miss: float = MISS_PROBABILITY) -> float:
    """Largest load of a document's bins for items of which ``fewest`` members must be found.

    Document and item together have at most ``1 / threshold`` times the document's members. That one member is not the least
    of its bin makes it no likelier for others, so the probabilities multiply.
    """
    low, high = 2.0**-45, 2.0**45
    for _ in range(100):
        middle = math.sqrt(low * high)
        share = least_share(middle)
        found = share >= 1 or max(1, fewest) * math.log1p(-share) <= math.log(miss)
        low, high = (middle, high) if found else (low, middle)
    return low * threshold


def class_loads(items: DataFrame, threshold: float, miss: float) -> dict[int, float]:
    """To each size class of the items, by powers of two, its load; it follows from the shortest item of the class."""
    shortest = items.groupBy("class").agg(F.min(F.size("members")).alias("least"))
    return {row["class"]: load_for(math.ceil(row.least * threshold), threshold, miss) for row in shortest.toLocalIterator()}


def contained_items(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = SIZE,
    threshold: float = THRESHOLD,
    miss: float = MISS_PROBABILITY,
) -> DataFrame:
    """Pairs of a document and an item of whose members it holds at least ``threshold``.

    Returns key, item key, ``n_item_members, n_shared, containment``, one row per pair. An item with fewer than
    ``size`` words is found only where it is the whole text. Items without words are in no document. Rows that repeat
    a key add nothing but their matches; rows with a null key are left out. Item members are broadcast after they have
    been counted; more than ``MAX_BROADCAST_MEMBERS`` are joined by shuffles. Other columns are not read.
    """
    named_items = items.select(items[item_key].alias("item"), items[item_text].alias("text")).filter("item is not null")
    classed = with_members(named_items, size).filter(F.size("members") > 0).distinct()
    sets = written(classed.withColumn("class", F.floor(F.log2(F.size("members"))).cast("int")), "items")
    small = (sets.agg(F.sum(F.size("members"))).first()[0] or 0) <= MAX_BROADCAST_MEMBERS
    loads = class_loads(sets, threshold, miss)
    sized = lambda frame: F.broadcast(frame) if small else frame

    named = documents.select(documents[key].alias("doc"), documents[text].alias("text")).filter("doc is not null")
    signed = document_signatures(with_members(named, size), list(loads.values()), threshold)
    load = F.coalesce(*[F.when(F.col("class") == number, load) for number, load in loads.items()], F.lit(1.0))
    bits = partition_bits(F.col("n_members"), load)
    least = (F.col("item_bits") <= bits) & (_least_from("member", "before") <= bits)
    least &= F.col("member").bitwiseAND(F.lit(_PARTS - 1)) < part_taken(F.col("n_members"), load, threshold)
    matched = signed.join(sized(item_signatures(sets)), "member").filter(least)
    candidates = written(matched.select("doc", "item").distinct(), "candidates")

    wanted = candidates.select("doc").distinct()
    few = wanted.count() <= MAX_BROADCAST_MEMBERS
    texts = with_members(named.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi"), size)
    pairs = candidates.join(texts, "doc").join(sized(sets.select("item", F.col("members").alias("item_members"))), "item")
    shared = F.size(F.array_intersect("members", "item_members"))
    sizes = pairs.select("doc", "item", F.size("item_members").alias("n_item_members"), shared.alias("n_shared"))
    best = sizes.groupBy("doc", "item").agg(F.max(F.struct("n_shared", "n_item_members")).alias("best"))
    containment = F.col("best.n_shared") / F.col("best.n_item_members")
    return best.filter(F.col("best.n_shared") >= F.col("best.n_item_members") * F.lit(threshold)).select(
        F.col("doc").alias(key),
        F.col("item").alias(item_key),
        F.col("best.n_item_members").cast("long").alias("n_item_members"),
        F.col("best.n_shared").cast("long").alias("n_shared"),
        containment.alias("containment"),
    )


def decontaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of documents that contain no item; rows with a null key stay."""
    found = contained_items(documents, items, key, **options)
    return documents.join(written(found.select(key).distinct(), "contaminated"), key, "left_anti")
