"""License scans: Aho-Corasick over the words of whole texts, and a shunting-yard parser for license expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.scan import LOWERED, slices, table, words
from tickloom.llm.workers import ship, tidied

#: Phrases that count as base places, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and the labels they stand for.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"
#: Beginnings of identifiers, their labels, and whether they ask for the same license on derived works.
FAMILIES = {
    "mit": ("mit", False),
    "apache": ("apache", False),
    "gpl": ("gpl", True),
    "lgpl": ("lgpl", True),
    "agpl": ("agpl", True),
    "mpl": ("mpl", True),
    "epl": ("epl", True),
    "bsd": ("bsd", False),
    "isc": ("isc", False),
    "bsl": ("bsl", False),
    "cc-by-sa": ("cc-by-sa", True),
    "cc-by": ("cc-by", False),
    "cc0": ("cc0", False),
    "unlicense": ("unlicense", False),
    "0bsd": ("0bsd", False),
    "afl": ("afl", False),
    "apsl": ("apsl", True),
    "artistic": ("artistic", False),
    "blueoak": ("blueoak", False),
    "cc-by-nc": ("cc-by-nc", False),
    "cc-by-nc-sa": ("cc-by-nc-sa", True),
    "cddl": ("cddl", True),
    "cecill": ("cecill", True),
    "cecill-b": ("cecill-b", False),
    "cecill-c": ("cecill-c", True),
    "cpal": ("cpal", True),
    "cpl": ("cpl", True),
    "curl": ("curl", False),
    "ecl": ("ecl", False),
    "eupl": ("eupl", True),
    "ftl": ("ftl", False),
    "gfdl": ("gfdl", True),
    "hpnd": ("hpnd", False),
    "icu": ("icu", False),
    "ijg": ("ijg", False),
    "ipl": ("ipl", True),
    "libpng": ("libpng", False),
    "lppl": ("lppl", False),
    "ms-pl": ("ms-pl", False),
    "ms-rl": ("ms-rl", True),
    "mulanpsl": ("mulanpsl", False),
    "ncsa": ("ncsa", False),
    "npl": ("npl", True),
    "odbl": ("odbl", True),
    "ofl": ("ofl", True),
    "openssl": ("openssl", False),
    "osl": ("osl", True),
    "php": ("php", False),
    "postgresql": ("postgresql", False),
    "psf": ("psf", False),
    "python": ("python", False),
    "qpl": ("qpl", True),
    "rpl": ("rpl", True),
    "sissl": ("sissl", True),
    "sleepycat": ("sleepycat", True),
    "spl": ("spl", True),
    "sspl": ("sspl", True),
    "upl": ("upl", False),
    "w3c": ("w3c", False),
    "wtfpl": ("wtfpl", False),
    "x11": ("x11", False),
    "zlib": ("zlib", False),
    "zpl": ("zpl", False),
}
#: Exceptions after which linked works need not follow the license.
LINKING_EXCEPTIONS = {
    "autoconf-exception",
    "bison-exception",
    "classpath-exception",
    "font-exception",
    "gcc-exception",
    "gnat-exception",
    "libtool-exception",
    "linux-syscall-note",
    "llvm-exception",
    "ocaml-lgpl-linking-exception",
    "openjdk-assembly-exception",
    "qt-lgpl-exception",
    "universal-foss-exception",
    "wxwindows-exception",
}
#: Confidence by the strongest sign found; an expression with a name that no family has says less than a phrase.
EXPRESSION_SCORE, PHRASE_SCORE, UNKNOWN_SCORE, BROKEN_SCORE = 1.0, 0.8, 0.6, 0.5

SEPARATORS = table(bytes(b for b in range(128) if not chr(b).isdigit() and not chr(b).islower()))
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Expression:
    """A license expression: normalised text, labels of the known licenses in it, and whether some choice avoids copyleft.

    ``permissive`` is None where that hangs on a name that is not known; ``known`` tells whether all names are.
    """

    text: str
    labels: frozenset[str]
    permissive: bool | None
    known: bool = True


def _license(name: str) -> Expression:
    """One name. ``NONE``, ``NOASSERTION``, references and all other names without a family are unknown, no licenses."""
    own = name.lower().rstrip(".:-")
    stem = max((f for f in FAMILIES if own == f or own.startswith((f + "-", f + "+"))), key=len, default=None)
    if stem is None:
        return Expression(name.rstrip(".:-"), frozenset(), None, False)
    label, copyleft = FAMILIES[stem]
    return Expression(name.rstrip(".:-"), frozenset([label]), not copyleft)


def _all(values: Iterable[bool | None]) -> bool | None:
    """``and`` of truths that may be unknown."""
    found = list(values)
    return False if False in found else None if None in found else True


def _any(values: Iterable[bool | None]) -> bool | None:
    found = list(values)
    return True if True in found else None if None in found else False


def _apply(operator: str, left: Expression, right: Expression) -> Expression:
    text = f"({left.text} {operator.upper()} {right.text})"
    if operator == "with":
        # What follows is the name of an exception, not of a license.
        name = re.sub(r"-[0-9.]+$", "", right.text.lower())
        return Expression(text, left.labels, True if left.known and name in LINKING_EXCEPTIONS else left.permissive, left.known)
    both = (left.permissive, right.permissive)
    return Expression(text, left.labels | right.labels, _any(both) if operator == "or" else _all(both), left.known and right.known)


def parse_expression(text: str) -> Expression | None:
    """Evaluate the license expression a text begins with, by two stacks; None if there is none.

    ``with`` binds before ``and``, that before ``or``; names of operators may have any case. What cannot go on the
    expression ends it. An open parenthesis that is never closed, or an operator without a right side, is no expression.
    """
    values: list[Expression] = []
    operators: list[str] = []
    expects_value, at = True, 0

    def reduce() -> None:
        right, left = values.pop(), values.pop()
        values.append(_apply(operators.pop(), left, right))

    while found := _TOKEN.match(text, at):
        token, at = found[1], found.end()
        word = token.lower()
        if expects_value:
            if token == "(":
                operators.append(token)
                continue
            if token == ")" or word in _RANK:
                return None
            values.append(_license(token))
            expects_value = False
            if token[-1] in ".:":
                break
        elif word in _RANK:
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[word]:
                reduce()
            operators.append(word)
            expects_value = True
        elif token == ")" and "(" in operators:
            while operators[-1] != "(":
                reduce()
            operators.pop()
        else:
            break
    if expects_value or "(" in operators:
        return None
    while operators:
        reduce()
    return values[0]


def _automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for phrase in [*BASE_PHRASES, *NOTICES, TAG]:
        padded = f" {phrase} "
        built.add_word(padded, (phrase, len(padded)))
    built.make_automaton()
    return built


class Scanner:
    """Finds all places of the phrases in the texts of a slice; lives in one task."""

    def __init__(self) -> None:
        self._automaton = _automaton()

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, str, int]]]:
        """Words per text, and (text, word, phrase, end byte in the text) of every place."""
        ends = offsets[1:]
        spaced = np.insert(LOWERED[data], ends, 10)
        borders = offsets + np.arange(len(offsets))
        found = words(spaced, borders, SEPARATORS, hashed=False)
        apart = SEPARATORS[spaced]
        kept = ~apart
        kept[1:] |= apart[1:] & ~apart[:-1]
        normal = np.where(apart, np.uint8(32), spaced)[kept]
        padded = b" " + normal.tobytes() if len(normal) and normal[0] != 32 else normal.tobytes()
        blank = np.frombuffer(padded, np.uint8) == 32
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        hits = []
        for end, (phrase, length) in self._automaton.iter(padded.decode("latin-1")):
            word = int(np.searchsorted(starts, end - length + 2))
            last = word + phrase.count(" ")
            text = int(np.searchsorted(found.first, word, "right")) - 1
            if last < found.first[text + 1]:
                hits.append((text, word - int(found.first[text]), phrase, int(found.ends[last] - borders[text])))
        return found.counts, hits


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_words, n_base, first_word, last_word, base_labels, labels, expressions, permissive, score``.

    Base places are those of ``BASE_PHRASES``. ``labels`` adds those of other notices and of the expressions that
    follow an identifier tag up to the end of its line; a name that belongs to no known family has no label.
    ``permissive`` tells whether all expressions can be met without copyleft, null if there is none or that hangs on an
    unknown name. ``score`` is 1 with an expression of known licenses, 0.8 with a phrase, 0.6 with an expression of which
    some name is unknown, 0.5 if there is only a tag without a valid expression, else 0. Null and empty texts have no words
    and empty labels. Every input row gives one row. Other columns are not read.
    """
    ship(df.sparkSession)
    names = ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "permissive", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                counts, hits = scanner.places(part.bytes, part.offsets)
                texts: dict[int, list] = {}
                for text, *place in hits:
                    texts.setdefault(text, []).append(place)
                rows = [_summary(texts.get(i, []), part, i) for i in range(len(counts))]
                columns = [part.rows.column(0), pa.array(counts.astype(np.int64))]
                columns += [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(_KINDS)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType(
        [
            T.StructField("key", df.schema[key].dataType),
            *[T.StructField(name, T.LongType()) for name in names[1:5]],
            *[T.StructField(name, T.StringType()) for name in names[5:7]],
            T.StructField("expressions", T.ArrayType(T.StringType())),
            T.StructField("permissive", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(tidied(scan), schema).withColumnRenamed("key", key)


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.float64()]


def _summary(places: list, part, text: int) -> tuple:
    base = [(word, phrase) for word, phrase, _ in places if phrase in BASE_PHRASES]
    starts = [word for word, _ in base]
    base_labels = {BASE_PHRASES[phrase] for _, phrase in base}
    labels = base_labels | {NOTICES[phrase] for _, phrase, _ in places if phrase in NOTICES}
    tags = [end for _, phrase, end in places if phrase == TAG]
    expressions, score = [], 0.0
    if tags:
        raw = part.bytes[part.offsets[text] : part.offsets[text + 1]].tobytes()
        for end in tags:
            stop = raw.find(b"\n", end)
            line = raw[end : stop if stop >= 0 else len(raw)].decode("utf-8", "replace")
            found = parse_expression(line.lstrip(" \t:=\"'"))
            if found:
                expressions.append(found)
                labels |= found.labels
        score = EXPRESSION_SCORE if any(e.known for e in expressions) else UNKNOWN_SCORE if expressions else BROKEN_SCORE
    if any(phrase != TAG for _, phrase, _ in places):
        score = max(score, PHRASE_SCORE)
    return (
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        [e.text for e in expressions],
        _all(e.permissive for e in expressions) if expressions else None,
        score,
    )
