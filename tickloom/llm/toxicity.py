"""Toxicity by a classifier chain: linear models for one category after the other.

Each model sees the words of a text and their beginnings of four to seven characters (as 64-bit hashes), each with its
damped share of the text's words, and the probabilities of the categories before it. Beginnings find signs that stand
before ever other endings, each full word too rare to learn; shares tell a text full of a sign from a long one that has
it by chance. A later model is trained on out-of-fold probabilities of the earlier ones, so that it learns how far they
can be trusted on texts they have not seen. A model keeps only features that clearly more texts of one class have, so
that a long text is not judged by the many words that say nothing. Models are fitted on a bounded sample of labelled
rows; all rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.scan import LOWERED, Slice, mixed, slices, span_hashes, table, words
from tickloom.llm.workers import ship, tidied
from tickloom.session import written

#: Most labelled documents a chain is fitted on: those with the smallest hash of their key.
MAX_SAMPLE = 12_000
FOLDS, ROUNDS, RATE, PENALTY = 3, 300, 0.5, 1e-4
#: A word or beginning counts for a category if this many sample texts have it and its shares differ by so many deviations.
MIN_TEXTS, MIN_DEVIATIONS = 4, 6.0
#: Characters of the beginnings, and the factor of a share before it is damped by a logarithm.
BEGINNINGS, SHARE_SCALE = (4, 5, 6, 7), 20.0

_SEPARATORS = table(bytes(b for b in range(128) if not chr(b).isalnum()))


def features(part: Slice, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and damped share of the different words and beginnings of each text, by owner.

    With ``known`` (sorted hashes) only of those. A word is a beginning of itself; characters are those of UTF-8.
    """
    data = LOWERED[part.bytes]
    found = words(data, part.offsets, _SEPARATORS, hashed=False)
    leading = (data & 0xC0) != 0x80
    places = np.append(np.flatnonzero(leading), len(data))
    before = np.concatenate([[0], np.cumsum(leading)])
    text = np.repeat(np.arange(len(part.offsets) - 1), found.counts)
    starts, ends, owner, kind = [found.starts], [found.ends], [text], [np.zeros(len(text), np.uint64)]
    for size in BEGINNINGS:
        at = before[found.starts] + size
        fits = at <= before[found.ends]
        starts.append(found.starts[fits])
        ends.append(np.minimum(places[at[fits]], found.ends[fits]))
        owner.append(text[fits])
        kind.append(np.full(len(owner[-1]), size, np.uint64))
    owner, kind = np.concatenate(owner), np.concatenate(kind)
    hashes = span_hashes(data.astype(np.uint64) + np.uint64(1), np.concatenate(starts), np.concatenate(ends))
    hashes = np.where(kind > 0, mixed(hashes + kind * np.uint64(0x9E3779B97F4A7C15)), hashes)
    if known is not None:
        hit = _places(known, hashes)[0]
        owner, hashes = owner[hit], hashes[hit]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(owner)))
    owner = owner[new]
    return owner, hashes[new], np.log1p(SHARE_SCALE * times / found.counts[owner]).astype(np.float32)


def _places(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the known (sorted) ones, and their numbers there."""
    if not len(known):
        return np.zeros(len(hashes), bool), np.empty(0, int)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    return hit, at[hit]


@dataclass
class Linear:
    """Logistic model: weights of its words and beginnings (sorted hashes), a weight per earlier category, and a constant."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def score(self, owner: np.ndarray, feature: np.ndarray, values: np.ndarray, before: np.ndarray) -> np.ndarray:
        hit, at = _places(self.words, feature)
        sums = np.bincount(owner[hit], weights=self.weights[at] * values[hit], minlength=len(before))
        return _logistic(sums + before @ self.earlier + self.constant)


def _logistic(sums: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def telling_words(owner: np.ndarray, feature: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words and beginnings whose share of texts differs clearly between the classes."""
    different, which = np.unique(feature, return_inverse=True)
    with_it = np.bincount(which, minlength=len(different))
    positive = np.bincount(which, weights=labels[owner], minlength=len(different))
    n, n1 = len(labels), labels.sum()
    if not 0 < n1 < n:
        return different[:0]
    share = with_it / n
    spread = np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1))) + 1e-12
    deviations = np.abs(positive / n1 - (with_it - positive) / (n - n1)) / spread
    return different[(with_it >= MIN_TEXTS) & (deviations >= MIN_DEVIATIONS)]


def fit_linear(owner: np.ndarray, feature: np.ndarray, values: np.ndarray, before: np.ndarray, labels: np.ndarray) -> Linear:
    """Logistic regression by full-batch steps with a rate per weight; the same result on every run."""
    telling = telling_words(owner, feature, labels)
    width, count = len(telling), len(labels)
    hit, at = _places(telling, feature)
    own = owner[hit]
    others = np.column_stack([before, np.ones(count)])
    rows = np.concatenate([own, np.repeat(np.arange(count), others.shape[1])])
    columns = np.concatenate([at, np.tile(np.arange(others.shape[1]) + width, count)])
    values = np.concatenate([values[hit], others.ravel()])
    weights, total = np.zeros(width + others.shape[1]), np.zeros(width + others.shape[1])
    for _ in range(ROUNDS):
        errors = _logistic(np.bincount(rows, weights=weights[columns] * values, minlength=count)) - labels
        gradient = np.bincount(columns, weights=errors[rows] * values, minlength=len(weights)) + PENALTY * weights
        total += gradient**2
        weights -= RATE * gradient / np.sqrt(total + 1e-12)
    return Linear(telling, weights[:width], weights[width:-1], float(weights[-1]))


def _folds(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def fit_chain(
    owner: np.ndarray, feature: np.ndarray, keys: np.ndarray, labels: np.ndarray, values: np.ndarray | None = None
) -> list[Linear]:
    """One model per column of ``labels``; folds follow from a hash of the key. Without ``values`` each counts as 1."""
    count = len(labels)
    values = np.ones(len(feature), np.float32) if values is None else values
    fold = _folds(keys)
    before, models = np.empty((count, 0)), []
    for k in range(labels.shape[1]):
        models.append(fit_linear(owner, feature, values, before, labels[:, k]))
        held = np.zeros(count)
        for f in range(FOLDS if k + 1 < labels.shape[1] else 0):
            learned, own = fold != f, np.cumsum(fold != f) - 1
            if learned.any():
                use = learned[owner]
                model = fit_linear(own[owner[use]], feature[use], values[use], before[learned], labels[learned, k])
                held[~learned] = model.score(owner, feature, values, before)[~learned]
        before = np.column_stack([before, held])
    return models


def apply_chain(
    models: list[Linear], owner: np.ndarray, feature: np.ndarray, count: int, values: np.ndarray | None = None
) -> np.ndarray:
    values = np.ones(len(feature), np.float32) if values is None else values
    before = np.empty((count, 0))
    for model in models:
        before = np.column_stack([before, model.score(owner, feature, values, before)])
    return before


def train_chain(
    documents: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    max_sample: int = MAX_SAMPLE,
) -> list[Linear]:
    """Fit a chain on at most ``max_sample`` labelled rows, whose telling features come to the driver.

    ``labels`` has the key and a 0/1 column per category; rows with a null are not used, nor keys without a text.
    Of labels that repeat a key the largest counts, of texts that share a key the one with the smallest hash: a key gives
    one row. Without any usable row there are no models.
    """
    ship(documents.sparkSession)
    usable = labels.select(labels[key].alias("key"), *[labels[c].cast("int").alias(c) for c in categories]).dropna()
    unique = usable.groupBy("key").agg(*[F.max(c).alias(c) for c in categories])
    sample = written(unique.orderBy(F.xxhash64("key"), "key").limit(max_sample), "sample")

    names = ["key", "number", *categories]
    number = F.col("key").cast("long") if isinstance(documents.schema[key].dataType, T.IntegralType) else F.xxhash64("key")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, feature, values = features(part)
                fold = pa.array(_folds(np.asarray(part.rows.column(1), np.int64)))
                lists = _lists(owner, feature, values, part.rows.num_rows)
                yield pa.RecordBatch.from_arrays([*part.rows.columns[:-1], fold, *lists], [*names, "fold", "features", "values"])

    named = documents.select(documents[key].alias("key"), documents[text].alias("text")).dropna()
    # Combined inside each task, so that a key with very many rows sends one text per task.
    single = named.join(F.broadcast(sample), "key").groupBy("key", *categories).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = single.withColumn("number", number).select(*names, "text")
    lists = [T.StructField("features", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))]
    kept = chosen.drop("text").schema.fields
    schema = T.StructType([*kept, T.StructField("fold", T.LongType()), *lists])
    extracted = written(chosen.mapInArrow(tidied(extract), schema), "features")
    known = _telling_anywhere(extracted, categories)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.num_columns - 2)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(own)))
            feature, values = np.asarray(own.flatten()).view(np.uint64), np.asarray(batch.column(batch.num_columns - 1).flatten())
            hit = _places(known, feature)[0]
            found = _lists(owner[hit], feature[hit], values[hit], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], [*names, "features", "values"])

    few = extracted.drop("fold").mapInArrow(tidied(reduced), T.StructType([*kept, *lists]))
    rows = few.toArrow().combine_chunks().sort_by("key")
    if not rows.num_rows:
        return []
    lists = rows.column("features").combine_chunks()
    owner = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
    truth = np.column_stack([np.asarray(rows.column(c), float) for c in categories])
    values = np.asarray(rows.column("values").combine_chunks().flatten())
    return fit_chain(owner, np.asarray(lists.flatten()).view(np.uint64), np.asarray(rows.column("number")), truth, values)


def _lists(owner: np.ndarray, feature: np.ndarray, values: np.ndarray, count: int) -> list[pa.ListArray]:
    borders = pa.array(np.searchsorted(owner, np.arange(count + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(borders, pa.array(own)) for own in (feature.view(np.int64), values)]


def _telling_anywhere(extracted: DataFrame, categories: Sequence[str]) -> np.ndarray:
    """Sorted hashes of the features that ``telling_words`` keeps for any category, on all rows or on those of other folds.

    They are counted by an aggregate, so that the driver needs none of the others.
    """
    folds = range(FOLDS)
    counted = [F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in folds]
    counted += [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"p{k}_{f}") for k, c in enumerate(categories) for f in folds]
    totals = extracted.agg(*counted).first()
    tests = []
    for k in range(len(categories)):
        for use in [set(folds), *({*folds} - {f} for f in folds)]:
            n, n1 = sum(totals[f"n_{f}"] for f in use), sum(totals[f"p{k}_{f}"] or 0 for f in use)
            if not 0 < n1 < n:
                continue
            with_it, positive = sum(F.col(f"n_{f}") for f in use), sum(F.col(f"p{k}_{f}") for f in use)
            spread = F.sqrt(with_it / n * (1 - with_it / n) * (1 / n1 + 1 / (n - n1))) + 1e-12
            deviations = F.abs(positive / n1 - (with_it - positive) / (n - n1)) / spread
            tests.append((with_it >= MIN_TEXTS) & (deviations >= MIN_DEVIATIONS - 1e-6))
    if not tests:
        return np.empty(0, np.uint64)
    exploded = extracted.select("fold", *categories, F.explode("features").alias("feature"))
    telling = exploded.groupBy("feature").agg(*counted).filter(reduce(or_, tests)).select("feature").toArrow()
    return np.sort(np.asarray(telling.column(0).combine_chunks(), np.int64).view(np.uint64))


def predict(
    documents: DataFrame, models: list[Linear], categories: Sequence[str], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key and ``p_<category>`` for each. Null and empty texts get what the constants say; null without models."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(models)
    known = np.unique(np.concatenate([model.words for model in models])) if models else None
    names = [f"p_{category}" for category in categories]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                count = part.rows.num_rows
                if shared.value:
                    owner, feature, values = features(part, known)
                    found = apply_chain(shared.value, owner, feature, count, values)
                    columns = [pa.array(found[:, k]) for k in range(len(names))]
                else:
                    columns = [pa.nulls(count, pa.float64())] * len(names)
                yield pa.RecordBatch.from_arrays([part.rows.column(0), *columns], ["key", *names])

    schema = T.StructType([T.StructField("key", documents.schema[key].dataType)])
    for name in names:
        schema = schema.add(name, T.DoubleType())
    scored = documents.select(documents[key].alias("key"), documents[text].alias("text")).mapInArrow(tidied(score), schema)
    return scored.withColumnRenamed("key", key)


def labelled(labels: DataFrame) -> DataFrame:
    """Categories of the given labels: ``low_quality`` (quality 0) and, after it in the chain, ``toxic``."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic"))


CATEGORIES = ("low_quality", "toxic")
LIMIT = 0.4


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of documents ``doc_id, p_low_quality, p_toxic, rejected`` (``p_toxic`` above ``LIMIT``; false without models).

    Null and empty texts are scored by the models' constants, rows that repeat or have a null key each by their own text.
    Labels with nulls, or of documents that are not there, teach nothing. Other columns are not read; an empty table
    gives no rows.
    """
    models = train_chain(documents, labelled(labels), CATEGORIES)
    scored = predict(documents, models, CATEGORIES)
    return scored.withColumn("rejected", F.coalesce(F.col("p_toxic") > LIMIT, F.lit(False)))
