r"""URL filter: rules in a sorted array of 64-bit digests, memory-mapped by every task.

A rule is a host and the beginning of a path; it fits its host and all subdomains, on paths that start with its own. Spark
sorts the rules by the xxhash of ``host \0 path``; keys, ends, verdicts and full strings become four files that every
executor keeps once and its workers map into memory. A task makes the candidates of its urls (host suffixes by path
beginnings, of such lengths as occur among the rules), probes all of a batch by one vectorised binary search, and
compares the stored full string wherever a digest is found, going on over equal digests; so a collision decides nothing.
The longest rule wins. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.workers import hand_out, mapped, ship, tidied
from tickloom.session import written

#: Most rules and bytes of rules that are handed to every executor; more are joined by shuffles.
MAX_RULES, MAX_RULE_BYTES = 20_000_000, 1 << 30
VERDICTS = ("allow", "block")
_SEED = 42  # fixed value: the seed of Spark's xxhash64
_HOST_END, _PATH_END = re.compile(rb"[/?#]"), re.compile(rb"[?#]")
_PIECE = 1 << 20

#: Candidates' lengths: to each host length among the rules the path lengths, ascending.
Lengths = dict[int, list[int]]


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    end = _HOST_END.search(rest)
    host = rest[: end.start()] if end else rest
    after = rest[len(host) :]
    stop = _PATH_END.search(after)
    return host.lower(), after[: stop.start()] if stop else after


def candidates(host: bytes, path: bytes, lengths: Lengths) -> Iterator[bytes]:
    """``host \\0 path`` of every rule that could fit and has lengths that occur."""
    for size, beginnings in lengths.items():
        if size != len(host) and not (0 < size < len(host) and host[-size - 1] == 0x2E):
            continue
        own = host[len(host) - size :] + b"\0"
        for end in beginnings:
            if end > len(path):
                break
            yield own + path[:end]


@dataclass
class SortedRules:
    """Sorted digests with the full string and verdict of each rule."""

    digests: np.ndarray
    ends: np.ndarray
    blocks: np.ndarray
    strings: np.ndarray
    mask: int

    def rule(self, i: int) -> bytes:
        return self.strings[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """Number of the rule that equals each string, else -1."""
        digests = np.fromiter((digest(text, self.mask) for text in wanted), np.int64, len(wanted))
        at = np.searchsorted(self.digests, digests)
        found = np.full(len(wanted), -1, np.int64)
        open_ = np.arange(len(wanted))
        while len(open_):
            open_ = open_[at[open_] < len(self.digests)]
            open_ = open_[self.digests[at[open_]] == digests[open_]]
            same = np.array([self.rule(at[i]) == wanted[i] for i in open_], bool)
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return found


def digest(text: bytes, mask: int = -1) -> int:
    """Signed 64-bit xxhash, as Spark's; ``mask`` keeps some bits only, for tests of collisions."""
    value = xxhash.xxh64_intdigest(text, _SEED)
    return (value - (1 << 64) if value >> 63 else value) & mask


def _named_rules(rules: DataFrame, host: str, path: str, verdict: str, mask: int) -> DataFrame:
    """``digest, rule, host_size, path_size, blocks`` of every different rule. Of contradicting verdicts block counts."""
    lowered = F.translate(F.coalesce(rules[host], F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = rules.filter(rules[verdict].isin(*VERDICTS)).select(
        lowered.alias("host"), F.coalesce(rules[path], F.lit("")).alias("path"), (rules[verdict] == "block").alias("blocks")
    )
    rule = F.concat("host", F.lit("\0"), "path")
    sizes = [F.octet_length("host").alias("host_size"), F.octet_length("path").alias("path_size")]
    one = named.groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    return one.select(F.xxhash64(rule).bitwiseAND(F.lit(mask)).alias("digest"), rule.alias("rule"), *sizes, "blocks")


def _sorted_files(rules: DataFrame) -> list[str]:
    """Names of the handed-out files: digests, ends, verdicts, strings. Sorted by Spark, passed on piece by piece."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(text) for text in texts], np.int64)
            blocks = np.asarray(batch.column(2).to_pylist(), np.uint8)
            parts = [np.asarray(batch.column(0)).astype(np.int64), sizes, blocks]
            packed = [part.tobytes() for part in parts] + [b"".join(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary()) for value in packed], names)

    names = ["digests", "sizes", "blocks", "strings"]
    ordered = rules.select("digest", F.col("rule").cast("binary"), "blocks").orderBy("digest", "rule")
    packed = written(ordered.mapInArrow(tidied(pack), T.StructType([T.StructField(n, T.BinaryType()) for n in names])
                                        ).withColumn("piece", F.monotonically_increasing_id()), "rules")
    spark = rules.sparkSession

    def pieces(name: str) -> Iterator[bytes]:
        for row in packed.select("piece", name).orderBy("piece").toLocalIterator():
            yield bytes(row[name])

    def ends() -> Iterator[bytes]:
        before = 0
        for piece in pieces("sizes"):
            sums = np.cumsum(np.frombuffer(piece, np.int64)) + before
            before = int(sums[-1]) if len(sums) else before
            yield sums.tobytes()

    return [hand_out(spark, "digests", pieces("digests")), hand_out(spark, "ends", ends()),
            hand_out(spark, "verdicts", pieces("blocks")), hand_out(spark, "strings", pieces("strings"))]


def judged_urls(
    df: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    host: str = "host",
    path: str = "path",
    verdict: str = "verdict",
    default: str = "allow",
    max_rules: int = MAX_RULES,
    mask: int = -1,
) -> DataFrame:
    """Per row: key, ``host, path, rule, verdict``: of the rules that fit the longest, in bytes, then that of the longer host.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to ``?``, ``#`` or
    the end. Null urls and urls without ``://`` have both empty. ``rule`` is null where none fits; the verdict is ``default``
    then. Of ``rules`` (``host, path, verdict``) those with another verdict than allow or block are left out, a null host or
    path is empty, and an empty host fits empty hosts only; repeated rules count once, of contradicting ones block counts.
    Rows that repeat and rows with a null key are judged as any other. Other columns are not read; no rules give the default.
    """
    ship(df.sparkSession)
    known = written(_named_rules(rules, host, path, verdict, mask), "rules")
    sizes = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()
    lengths: Lengths = {}
    for row in known.select("host_size", "path_size").distinct().orderBy("host_size", "path_size").toLocalIterator():
        lengths.setdefault(row.host_size, []).append(row.path_size)
    named = df.select(df[key].alias("key"), df[url].alias("url"))
    if sizes[0] > max_rules or sizes[1] > MAX_RULE_BYTES:
        found = _joined(named, known, lengths, mask)
    else:
        found = _probed(named, _sorted_files(known), lengths, mask)
    shown = F.replace("rule", F.lit("\0"), F.lit(""))
    chosen = F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow").otherwise(F.lit(default))
    return found.select(F.col("key").alias(key), "host", "path", shown.alias("rule"), chosen.alias("verdict"))


def _texts(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _probed(named: DataFrame, files: list[str], lengths: Lengths, mask: int) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.uint8, np.uint8)
        array = SortedRules(*[mapped(name, kind) for name, kind in zip(files, kinds)], mask)
        for batch in batches:
            split = [split_url(value) for value in batch.column(1).cast(pa.binary()).to_pylist()]
            owner, wanted, rank = [], [], []
            for i, (host, path) in enumerate(split):
                for text in candidates(host, path, lengths):
                    owner.append(i)
                    wanted.append(text)
                    rank.append((len(text), text.index(b"\0")))
            best: dict[int, tuple] = {}
            found = array.find(wanted)
            for at in np.flatnonzero(found >= 0).tolist():
                best[owner[at]] = max(best.get(owner[at], ((-1, -1), -1)), (rank[at], int(found[at])))
            chosen = [best[i][1] if i in best else None for i in range(len(split))]
            columns = [
                batch.column(0),
                _texts([host for host, _ in split]),
                _texts([path for _, path in split]),
                _texts([None if i is None else array.rule(i) for i in chosen]),
                pa.array([None if i is None else bool(array.blocks[i]) for i in chosen], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "host", "path", "rule", "blocks"])

    return named.mapInArrow(tidied(judge), _schema(named, "host string, path string, rule string, blocks boolean"))


def _schema(named: DataFrame, rest: str) -> T.StructType:
    return T.StructType([named.schema["key"], *T.StructType.fromDDL(rest).fields])


def _joined(named: DataFrame, rules: DataFrame, lengths: Lengths, mask: int) -> DataFrame:
    """The same for rules beyond what executors may hold: candidates meet them by digest and full string."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [split_url(value) for value in batch.column(2).cast(pa.binary()).to_pylist()]
            wanted = [list(candidates(host, path, lengths)) for host, path in split]
            columns = [
                batch.column(1),
                batch.column(0),
                _texts([host for host, _ in split]),
                _texts([path for _, path in split]),
                pa.array([[digest(text, mask) for text in own] for own in wanted], pa.list_(pa.int64())),
                pa.array(wanted, pa.list_(pa.binary())).view(pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "row", "host", "path", "digests", "rules"])

    numbered = written(named.select(F.monotonically_increasing_id().alias("row"), "key", "url"), "urls")
    schema = _schema(named, "row bigint, host string, path string, digests array<bigint>, rules array<string>")
    expanded = written(numbered.mapInArrow(tidied(expand), schema), "candidates")
    each = expanded.select("row", F.explode(F.arrays_zip("digests", "rules")).alias("c"))
    each = each.select("row", F.col("c.digests").alias("digest"), F.col("c.rules").alias("rule"))
    rank = F.struct((F.col("host_size") + F.col("path_size")).alias("size"), "host_size", "rule", "blocks")
    best = each.join(rules, ["digest", "rule"]).groupBy("row").agg(F.max(rank).alias("best"))
    return expanded.join(best, "row", "left").select("key", "host", "path", "best.rule", "best.blocks")
