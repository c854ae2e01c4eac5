"""Words of whole texts in Arrow batches, found with numpy over the bytes of many texts at once.

A slice holds consecutive rows of a batch with some megabytes of text, or one text that is longer. Nothing is cut:
memory is bounded by the slice, or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: Moduli and bases of the two hashes of a run. Modulo a power of two a polynomial hash has collisions for every base.
_MODULI = ((2147483647, 1404928317), (2147483629, 773094113))
_POWERS: dict[tuple[int, int], np.ndarray] = {}
#: Sums of this many small values times a power stay below 2**64.
_SMALL, _LONGEST = 1 << 16, 1 << 16


def table(members: bytes) -> np.ndarray:
    """Lookup of 256 flags, true for the given bytes."""
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


#: Separators of words ``[^\x20\x09-\x0D]+``.
BLANKS = table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Lower case for A-Z, everything else as it is.
LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@dataclass
class Slice:
    """``bytes`` of all texts of ``rows`` one after the other; text i stands from ``offsets[i]`` to ``offsets[i + 1]``."""

    rows: pa.RecordBatch
    bytes: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Words in order: first and end byte, hash; text i has those from ``first[i]`` to ``first[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch into slices by the bytes of a text column. A null text counts as empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        own = offsets[begin : end + 1]
        yield Slice(batch.slice(begin, end - begin), data[own[0] : own[-1]], own - own[0])
        begin = end


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one, so that every bit depends on all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, modulus: int, count: int) -> np.ndarray:
    """``base ** i`` modulo the modulus for i below ``count``."""
    known = _POWERS.get((base, modulus), np.ones(1, np.uint32))
    while len(known) < count:
        step = np.uint64(pow(base, len(known), modulus))
        known = np.concatenate([known, (known * step % np.uint64(modulus)).astype(np.uint32)])
        _POWERS[base, modulus] = known
    return known[:count]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hash of each run ``values[start:end]``, scrambled, the same wherever the run stands; values must not be 0.

    Two polynomials modulo primes, as differences of running sums. A sum may wrap: the difference of two is right as long
    as it is below 2**64 itself, so terms are reduced only where values are large or runs long.
    """
    small = len(values) > 0 and int(values.max()) < _SMALL and int((ends - starts).max(initial=0)) < _LONGEST
    result = np.zeros(len(starts), np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    for number, base in _MODULI:
        modulus = np.uint64(number)
        terms = values if small else values % (modulus - np.uint64(1)) + np.uint64(1)
        terms = terms * _powers(base, number, len(values))
        np.cumsum(terms if small else terms % modulus, out=sums[1:])
        back = _powers(pow(base, -1, number), number, len(values) + 1)[starts]
        result = (result << np.uint64(31)) | ((sums[ends] - sums[starts]) % modulus * back % modulus)
    return mixed(result)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, hashed: bool = True) -> Words:
    """The maximal runs of bytes that are no separators; no word goes on into the next text."""
    apart = separators[data]
    inside = ~apart
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= apart[:-1]
    stops[:-1] &= apart[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begins[borders] = inside[borders]
    stops[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = span_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends) if hashed else np.empty(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``size`` consecutive words from each word on, and whether the window ends within its text."""
    count = len(found.hashes)
    hashes = np.zeros(count, np.uint64)
    for k in range(min(size, count)):
        weight = np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
        hashes[: count - k] += found.hashes[k:] * weight
    fits = np.arange(count) + size <= np.repeat(found.first[1:], found.counts)
    return mixed(hashes), fits


def shingle_sets(found: Words, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word windows.

    A text with fewer words has its whole sequence as the one member; a text without words has an empty set.
    """
    hashes, fits = windows(found, size)
    for begin, end in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if end - begin >= size:
            yield np.unique(hashes[begin:end][fits[begin:end]])
        elif end > begin:
            own = found.hashes[begin:end]
            yield span_hashes(own | np.uint64(1), np.zeros(1, int), np.array([end - begin])) ^ np.uint64(end - begin)
        else:
            yield np.empty(0, np.uint64)
