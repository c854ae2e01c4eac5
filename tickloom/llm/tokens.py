r"""Token counts and token ids of whole texts, by the installed tokenizer libraries inside Arrow functions.

Texts are split at safe boundaries before they are encoded. The byte-level pattern
(``'s|'t|...| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``) never joins a character that is no white space with
white space after it, nor a letter with a comma or full stop after it; so the pieces between such places give the
tokens of the whole text. The pieces of a slice are found with numpy over its bytes. Each different one goes to the
library once, in batches of equal size; what it gave is remembered in the worker under the piece's 64-bit hash, in a
table of bounded size. A tokenizer with another pattern, a normaliser or a prefix gets its texts whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.scan import BLANKS, Slice, slices, span_hashes, table
from tickloom.llm.workers import ship, tidied

BATCH_BYTES, SLICE_BYTES = 1 << 18, 1 << 20
#: Pieces remembered in each of two generations, and the longest of them in bytes.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64

_CONTROLS = table(bytes(b for b in range(32) if not BLANKS[b]) + b"\x7f")
_LETTERS = table(bytes(range(65, 91)) + bytes(range(97, 123)))
_STOPS = table(b",.")
#: First two bytes of characters beyond ASCII that some engine may count as white space, and the bytes after them.
_DOUBTFUL = {(0xC2, 0x85): 0, (0xC2, 0xA0): 0, (0xE1, 0x9A): 1, (0xE1, 0xA0): 1, (0xE2, 0x80): 1, (0xE2, 0x81): 1}
_DOUBTFUL |= {(0xE3, 0x80): 1, (0xEF, 0xBB): 1}

#: Pieces that start with white space and end in a character that is surely none.
_BETWEEN = re.compile(rb"[ \t-\r][^<]*[!-~]|[ \t-\r][^<]*\xc3[\x80-\xbf]", re.DOTALL)

_ENCODERS: dict[str, Encoder] = {}


@dataclass
class Tokens:
    """Ids of the texts of a slice: text i has ``counts[i]`` of them."""

    counts: np.ndarray
    _lengths: np.ndarray
    _begins: np.ndarray
    _pool: np.ndarray

    def ids(self) -> np.ndarray:
        """Ids of all texts one after the other."""
        total = int(self._lengths.sum())
        before = np.cumsum(self._lengths) - self._lengths
        return self._pool[np.repeat(self._begins - before, self._lengths) + np.arange(total)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces between safe boundaries; a text that is not empty starts one."""
    if not len(data):
        return np.empty(0, np.int64)
    white, sure = BLANKS[data], ~_CONTROLS[data]
    for (a, b), rest in _DOUBTFUL.items():
        found = np.flatnonzero((data[:-1] == a) & (data[1:] == b)) + 1 + rest
        sure[found[found < len(data)]] = False
    starts = np.zeros(len(data), bool)
    starts[1:] = (white[1:] & ~white[:-1] & sure[:-1]) | (_STOPS[data[1:]] & _LETTERS[data[:-1]])
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


class Encoder:
    """One tokenizer file in one worker: ``.json`` for tokenizers, ``.model`` for sentencepiece."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode: Callable[[list[str]], list] = lambda texts: model.encode(texts, num_threads=1)
            self._split = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: [
                found.ids for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
            self._split = _is_plain_byte_level(tokenizer)
            if self._split:
                vocabulary = tokenizer.get_vocab()
                self._token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
                self._token_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._known: dict[int, bytes] = {}
        self._older: dict[int, bytes] = {}

    def tokens(self, part: Slice) -> Tokens:
        if self._split:
            starts = piece_starts(part.bytes, part.offsets)
        else:
            starts = part.offsets[:-1][np.diff(part.offsets) > 0]
        ends = np.append(starts[1:], len(part.bytes))[: len(starts)]
        hashes = span_hashes(part.bytes.astype(np.uint64) + np.uint64(1), starts, ends)
        different, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = self._looked_up(different.tolist(), part.bytes, starts[at].tolist(), ends[at].tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        lengths = sizes[which]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(sums[np.searchsorted(starts, part.offsets)])
        return Tokens(counts, lengths, (np.cumsum(sizes) - sizes)[which], pool)

    def _looked_up(self, hashes: list[int], data: np.ndarray, begins: list[int], ends: list[int]) -> list[bytes]:
        """Packed ids of the different pieces of a slice."""
        found = [self._known.get(h) for h in hashes]
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = self._older.get(hashes[i])
                if ids is None:
                    new.append(i)
                else:
                    found[i] = self._known[hashes[i]] = ids
        raw = data.tobytes()
        for batch in balanced(new, lambda i: ends[i] - begins[i]):
            for i, ids in zip(batch, self._encoded([raw[begins[i] : ends[i]] for i in batch])):
                found[i] = ids
                if ends[i] - begins[i] <= LONGEST_REMEMBERED:
                    self._known[hashes[i]] = ids
        if len(self._known) > REMEMBERED:
            self._known, self._older = {}, self._known
        return found


    def _encoded(self, batch: list[bytes]) -> list[bytes]:
        """Packed ids of pieces. Those that may follow one another in a text are encoded as one and told apart by bytes."""
        chain = [i for i, piece in enumerate(batch) if self._split and _BETWEEN.fullmatch(piece)]
        joined = b"".join([batch[i] for i in chain])
        linked = set(chain)
        alone = [i for i in range(len(batch)) if i not in linked]
        ids, *others = self._encode([joined.decode(), *[batch[i].decode() for i in alone]])
        packed = [b""] * len(batch)
        for i, own in zip(alone, others):
            packed[i] = np.asarray(own, "<u4").tobytes()
        if chain:
            ids = np.asarray(ids, "<u4")
            borders = np.cumsum([len(batch[i]) for i in chain])
            reached = np.cumsum(self._token_bytes[ids])
            at = np.searchsorted(reached, borders)
            if not np.array_equal(reached[at], borders):
                raise ValueError("a token crosses a safe boundary")
            raw, begin = ids.tobytes(), 0
            for i, end in zip(chain, ((at + 1) * 4).tolist()):
                packed[i] = raw[begin:end]
                begin = end
        return packed


def _is_plain_byte_level(tokenizer) -> bool:
    says = json.loads(tokenizer.to_str())
    before, added = says["pre_tokenizer"] or {}, says["added_tokens"]
    return (
        says["normalizer"] is None
        and before.get("type") == "ByteLevel"
        and before["use_regex"]
        and not before["add_prefix_space"]
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        and not any(re.search(r"[\s,.]", t["content"]) for t in added)
    )


def balanced(items: list[int], size: Callable[[int], int], limit: int = BATCH_BYTES) -> Iterator[list[int]]:
    """Batches of about equal size: a batch ends as soon as it holds ``limit`` bytes."""
    batch, held = [], 0
    for item in items:
        batch.append(item)
        held += size(item)
        if held >= limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: the key, ``n_bytes`` (UTF-8), ``n_tokens`` without special tokens added, and ``over_limit``.

    ``tokenizer`` is a path that every worker can read. Null and empty texts have 0 bytes and 0 tokens. Every input
    row gives one row, repeated rows and null keys too. Other columns are not read.
    """
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                counts = own.tokens(part).counts
                columns = [part.rows.column(0), *map(pa.array, (np.diff(part.offsets), counts, counts > limit))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType(
        [
            T.StructField("key", df.schema[key].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    counted = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(tidied(count), schema)
    return counted.withColumnRenamed("key", key)
