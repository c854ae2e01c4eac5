"""Trailing stops from marks that do not say when their position was opened, as a stream.

Each micro-batch reduces the marks of a position to one stretch: its first and last mark, the opening of the run of marks
on one side that is open at its end, the best stop of that run, and the best stop before the first turn inside the
stretch. Stretches that follow one another add up to one, so parts merge as in :mod:`tickloom.streaming.changes` and nothing
is held between batches. Marks may come in any order within a batch; from batch to batch those of one position must not go
back in time: a late mark counts where the first mark of its batch stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.positions import stop_candidates, towards_profit
from tickloom.operators.segments import Buckets

_ORDER = ["mark_time", "mark_id"]
_STRETCH = ("first", "last", "opening", "best", "head")


def stretches(marks: DataFrame) -> DataFrame:
    """One row per position with the stretch of its marks. Windows and sums run in buckets, so a position may have any number."""
    scored = stop_candidates(marks).select(
        "position_id", *_ORDER, "side", towards_profit(F.col("candidate"), F.col("side")).alias("score"), F.lit(1).alias("one")
    )
    buckets = Buckets(scored, ["position_id"], _ORDER)
    rows = buckets.previous(buckets.placed(scored), "side", "before")
    rows = buckets.previous(rows, "one", "earlier")
    turned = F.col("earlier").isNotNull() & ~F.col("side").eqNullSafe(F.col("before"))
    runs = buckets.running(rows.withColumn("turn", turned.cast("long")), {"run": ("sum", "turn")})
    mark = F.struct(*_ORDER, "side")
    each = runs.groupBy("position_id", "run").agg(F.min(mark).alias("first"), F.max(mark).alias("last"), F.max("score").alias("best"))
    ends = each.groupBy("position_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max_by(F.struct("run", "first", "best"), "run").alias("open"),
        F.min_by(F.struct("best"), "run").alias("head"),
    )
    opening = F.when(F.col("open.run") > 0, F.struct(F.col("open.first.mark_time"), F.col("open.first.mark_id")))
    return ends.select("position_id", "first", "last", opening.alias("opening"), F.col("open.best").alias("best"), F.col("head.best").alias("head"))


def join_stretches(parts: DataFrame) -> DataFrame:
    """The stretches of each position one after the other; the merge of this stream. A position has one per part."""
    stretch = F.struct(*_STRETCH)
    ordered = F.sort_array(F.collect_list(stretch))
    first = F.get(ordered, F.lit(0))
    whole = F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), first, _joined)
    return parts.groupBy("position_id").agg(whole.alias("whole")).select("position_id", *[f"whole.{name}" for name in _STRETCH])


def _joined(a: Column, b: Column) -> Column:
    turns = ~a["last"]["side"].eqNullSafe(b["first"]["side"])
    opening = F.when(b["opening"].isNotNull(), b["opening"]).when(turns, _moment(b["first"])).otherwise(a["opening"])
    best = F.when(b["opening"].isNotNull() | turns, b["best"]).otherwise(F.greatest(a["best"], b["best"]))
    head = F.when(a["opening"].isNotNull() | turns, a["head"]).otherwise(F.greatest(a["head"], b["head"]))
    values = (a["first"], b["last"], opening, best, head)
    return F.struct(*[value.alias(name) for name, value in zip(_STRETCH, values)])


def _moment(mark: Column) -> Column:
    return F.struct(mark["mark_time"].alias("mark_time"), mark["mark_id"].alias("mark_id"))


def open_stops(joined: DataFrame) -> DataFrame:
    """``position_id, side, opened_at, opened_by, stop`` of the positions that are open and have reached a stop since they were opened.

    ``opened_at`` and ``opened_by`` are the time and id of the mark that opened the position on this side.
    """
    side, opening = F.col("last.side"), F.coalesce("opening", _moment(F.col("first")))
    found = joined.filter(side.isNotNull() & F.col("best").isNotNull())
    return found.select(
        "position_id", side.alias("side"), opening["mark_time"].alias("opened_at"), opening["mark_id"].alias("opened_by"),
        towards_profit(F.col("best"), side).alias("stop"),
    )
