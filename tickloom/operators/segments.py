"""Ordered operators over keys of any size, with one shuffle of the rows.

A window partitioned by a key puts the whole key into one task, and one asset may hold a third of all rows. Here the
keys with more than ``spark.tickloom.segment.rows`` rows are cut into buckets of about that size. A bucket begins at a
row, not at a moment, so many rows of one moment are spread as well: the bounds are rows of an even sample (taken by the
hash of their order, so that it is the same when lost tasks run again) and only balance the work. Each row finds its
bucket by binary search in the bounds of its key, a few comparisons in generated code, and the windows run within
(key, bucket): one hash exchange, nothing is written but the bounds.

What crosses a border comes from a rollup with one row per bucket, aggregated before its shuffle from the columns it
needs. The frame is read again for that, so it must give the same rows each time. Without a large key all this falls
away and the window is an ordinary one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.moments import order_value
from tickloom.session import broadcast_if_small, written, written_counted

SEGMENT_ROWS, DEFAULT_ROWS = "spark.tickloom.segment.rows", 500_000
SAMPLES_PER_BUCKET = 32
# Bounds and border rows joined by broadcast: at most this many keys and buckets.
MAX_BROADCAST_SEGMENTS = 200_000

#: Aggregate of a running value and how a total carried from earlier rows joins it.
_KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda carried, inside: F.coalesce(carried + inside, carried, inside)),
}


def free_name(df: DataFrame, label: str) -> str:
    """A column name like ``label`` that the frame does not have, so that no column of the caller is overwritten."""
    taken = {name.lower() for name in df.columns}
    while label.lower() in taken:
        label += "_"
    return label


class Buckets:
    """The buckets of a frame's large keys. ``order`` must be unique per key, but for rows that are alike.

    :meth:`placed` adds the bucket column; :meth:`previous` and :meth:`running` add columns to such rows, one after the other
    without another shuffle; :meth:`plain` takes the bucket off again.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        self.keys, self.order = list(keys), list(order)
        self.bucket = free_name(df, "bucket")
        rows = int(df.sparkSession.conf.get(SEGMENT_ROWS, str(DEFAULT_ROWS)))
        large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(self.bucket)).filter(F.col(self.bucket) > rows).select(*keys)
        large, count = written_counted(large, "large_keys")
        self.bounds = written(self._bounds(df, large, rows), "bounds") if count else None

    def _bounds(self, df: DataFrame, large: DataFrame, rows: int) -> DataFrame:
        """Per large key the first row of every bucket but the first one."""
        spread = max(1, rows // SAMPLES_PER_BUCKET)
        sampled = df.filter(F.pmod(F.xxhash64(*self.order), F.lit(spread)) == 0).select(*self.keys, F.struct(*self.order).alias(self.bucket))
        side = broadcast_if_small(large, MAX_BROADCAST_SEGMENTS)
        sampled = sampled.join(side, [sampled[key].eqNullSafe(side[key]) for key in self.keys], "left_semi")
        ordered = sampled.groupBy(*self.keys).agg(F.sort_array(F.collect_list(self.bucket)).alias(self.bucket))
        step = SAMPLES_PER_BUCKET
        every = F.filter(self.bucket, lambda _, i: i % step == step - 1)
        return ordered.withColumn(self.bucket, every)

    def placed(self, df: DataFrame) -> DataFrame:
        """The rows with their bucket: 0 for small keys, else from 1 in the order of the key."""
        if self.bounds is None:
            return df.withColumn(self.bucket, F.lit(0))
        most = self.bounds.agg(F.max(F.size(self.bucket))).first()[0] or 0
        side = broadcast_if_small(self.bounds, MAX_BROADCAST_SEGMENTS)
        names = {key: free_name(df, f"of_{key}") for key in self.keys}
        bounds, at = free_name(df, "bounds"), self.bucket
        side = side.withColumnsRenamed({**names, self.bucket: bounds})
        found = df.join(side, [df[key].eqNullSafe(side[name]) for key, name in names.items()], "left")
        found = found.select(*[df[name] for name in df.columns], bounds, F.lit(0).alias(at))
        row = F.struct(*self.order)
        for step in reversed([1 << k for k in range(most.bit_length())]):
            further = F.get(bounds, F.col(at) + (step - 1)) <= row
            found = found.withColumn(at, F.when(further, F.col(at) + step).otherwise(F.col(at)))
        return found.withColumn(at, F.when(F.col(bounds).isNull(), 0).otherwise(F.col(at) + 1)).drop(bounds)

    def plain(self, rows: DataFrame) -> DataFrame:
        return rows.drop(self.bucket)

    def inside(self, descending: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.keys, self.bucket).orderBy(*[F.col(n).desc() if descending else F.col(n).asc() for n in self.order])

    def previous(self, rows: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
        """Add ``value`` of the row just before, as ``lag`` over the whole key would."""
        inside = self.inside(descending)
        if self.bounds is None:
            return rows.withColumn(name, F.lag(value).over(inside))
        first, carried = free_name(rows, "first_row"), free_name(rows, "carried")
        nearest = F.min_by if descending else F.max_by
        moment = order_value(rows, self.order) if len(self.order) > 1 else None
        ends = self._rollup(rows, {carried: nearest(value, F.struct(*self.order) if moment is None else moment)})
        along = Window.partitionBy(*self.keys).orderBy(F.col(self.bucket).desc() if descending else F.col(self.bucket))
        ends = ends.withColumn(carried, F.lag(carried).over(along))
        marked = rows.withColumns({name: F.lag(value).over(inside), first: F.lag(F.lit(False), 1, True).over(inside)})
        joined = self._with_carried(marked, ends, [carried])
        return joined.withColumn(name, F.when(F.col(first), F.col(carried)).otherwise(F.col(name))).drop(first, carried)

    def running(self, rows: DataFrame, totals: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
        """Add totals from the first row of the key up to this one; each is ``max`` or ``sum`` and what it is taken of."""
        so_far = self.inside().rowsBetween(Window.unboundedPreceding, 0)
        found = rows.withColumns({name: _KINDS[kind][0](value).over(so_far) for name, (kind, value) in totals.items()})
        if self.bounds is None:
            return found
        carried = {name: free_name(found, f"carried_{name}") for name in totals}
        ends = self._rollup(rows, {carried[name]: _KINDS[kind][0](value) for name, (kind, value) in totals.items()})
        earlier = Window.partitionBy(*self.keys).orderBy(self.bucket).rowsBetween(Window.unboundedPreceding, -1)
        before = {carried[name]: _KINDS[kind][0](carried[name]).over(earlier) for name, (kind, _) in totals.items()}
        joined = self._with_carried(found, ends.withColumns(before), list(carried.values()))
        types = {field.name: field.dataType for field in found.schema}
        both = {name: _KINDS[kind][1](F.col(carried[name]), F.col(name)).cast(types[name]) for name, (kind, _) in totals.items()}
        return joined.withColumns(both).drop(*carried.values())

    def _rollup(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        grouped = rows.filter(F.col(self.bucket) > 0).groupBy(*self.keys, self.bucket)
        return grouped.agg(*[value.alias(name) for name, value in values.items()])

    def _with_carried(self, rows: DataFrame, ends: DataFrame, carried: list[str]) -> DataFrame:
        """Rows with the carried columns of their bucket. The rollup is small, or joined as any other side."""
        side = broadcast_if_small(written(ends, "borders"), MAX_BROADCAST_SEGMENTS)
        same = [rows[name].eqNullSafe(side[name]) for name in (*self.keys, self.bucket)]
        return rows.join(side, same, "left").select(*[rows[name] for name in rows.columns], *[side[name] for name in carried])


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, descending: bool = False
) -> DataFrame:
    """Add ``value`` of the row just before, as ``lag`` over the whole key would. ``order`` must be unique per key."""
    buckets = Buckets(df, keys, order)
    return buckets.plain(buckets.previous(buckets.placed(df), value, name, descending))


def with_running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the maximum of ``value`` from the first row of the key up to this one."""
    buckets = Buckets(df, keys, order)
    return buckets.plain(buckets.running(buckets.placed(df), {name: ("max", value)}))
