"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import written

MAX_ROUNDS = 40


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.union(turned)


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.filter(F.col("b") > F.col("a"))
    return larger.join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the least neighbour."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    hung = moved.filter(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node) for all nodes of links ``a, b``; nodes without links are left out.

    Links of a node to itself and rows with nulls say nothing. Each round writes its links to the shared folder, so
    that lost executors cost one round. Aggregates combine before their shuffles, and joins on a hot node are split by
    adaptive execution. Empty links give an empty result.
    """
    pairs = links.filter(F.col("a") != F.col("b"))
    current = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = _state(current)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        current = written(_small_star(_large_star(current)), "links")
        state = _state(current)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    """Count and order-free hash of the links, enough to see that a round changed nothing."""
    both = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count("*"), F.sum(both)).first())
