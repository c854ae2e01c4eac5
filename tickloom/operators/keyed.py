"""Key-value state as tables: the newest item of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.moments import order_value
from tickloom.operators.segments import free_name
from tickloom.session import written_counted

SECONDS_PER_DAY = 86400
# Keys with their newest moment joined by broadcast, some fifty bytes each.
MAX_BROADCAST_KEYS = 1_000_000


def latest_per_key(puts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole last item of every key, nulls included; older items leave nothing behind.

    First the newest moment of every key, a hash aggregate of fixed width that combines inside each task; then the rows that
    have it, found by a join with those moments: broadcast where they are few, so that only winners are shuffled. Winners of
    one moment are one item, the same ones whatever the order of rows: whole items are compared then. ``puts`` is read twice
    and must give the same rows; an order without a value of fixed width is aggregated as structs, by sorting.
    """
    rest = [name for name in puts.columns if name not in keys]
    moment = order_value(puts, order)
    winners = puts if moment is None else _at_newest(puts, keys, moment)
    newest = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("newest")
    return winners.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def _at_newest(puts: DataFrame, keys: Sequence[str], moment: Column) -> DataFrame:
    """The puts at their key's newest moment; where a key has no moment at all, all of its puts."""
    names = {name: free_name(puts, f"of_{name}") for name in keys}
    own, newest = free_name(puts, "moment"), free_name(puts, "newest")
    dated = puts.withColumn(own, moment)
    tops, count = written_counted(dated.groupBy(*keys).agg(F.max(own).alias(newest)).withColumnsRenamed(names), "newest")
    side = F.broadcast(tops) if count <= MAX_BROADCAST_KEYS else tops
    same = [dated[name].eqNullSafe(side[names[name]]) for name in keys]
    return dated.join(side, [*same, dated[own].eqNullSafe(side[newest])], "left_semi").drop(own)


def stamped(items: DataFrame, updated_at: Column, expire_days: Column | None = None) -> DataFrame:
    """Add ``updated_at`` and, where a number of days is given, ``expiration_time`` in epoch seconds."""
    days = F.lit(None).cast("long") if expire_days is None else expire_days.cast("long")
    moment = F.unix_seconds(updated_at.cast("timestamp"))
    return items.withColumns({"updated_at": updated_at, "expiration_time": moment + days * F.lit(SECONDS_PER_DAY)})


def put(state: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State after a batch of puts. An attribute the new item lacks is null afterwards."""
    return latest_per_key(state.unionByName(batch, allowMissingColumns=True), keys, order)


def live(state: DataFrame, now_seconds: Column) -> DataFrame:
    """Items not yet expired."""
    return state.filter(F.col("expiration_time").isNull() | (F.col("expiration_time") > now_seconds))


def get(state: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of the wanted keys; keys without an item give no row."""
    return state.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def delete(state: DataFrame, unwanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State without the given keys."""
    return state.join(unwanted.select(*keys).distinct(), list(keys), "left_anti")
