"""Chat formatting: collapse logged snapshots of growing conversations, then render what is left.

A log holds a conversation again and again as it grows. Every turn gets the rolling hash of the turns up to it; a
conversation whose last hash is a hash inside a longer one is a prefix of that and goes. Of equal conversations the
smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import written

BLOCK = 1000
PART_BYTES = 64 << 20
START, END = "<|im_start|>", "<|im_end|>"


def rolling_hashes(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, place, h1, h2``: place in the conversation from 1, and the hash of all turns up to it.

    The rolling hash is the running sum of two 64-bit hashes of (place, role, text), exact in decimals: equal for equal
    prefixes, and for no others but by chance (128 bits). Windows run within blocks of turn numbers, and offsets of the
    blocks are added, so a conversation of any length is spread over tasks. Turns with one number are ordered by role
    and text, rows that repeat are turns of their own; a null turn number stands first, a null role or text is its own
    value. Rows without a conversation are left out.
    """
    named = turns.select(turns[key].alias("conv"), turns[turn].alias("turn"), turns[role].alias("role"), turns[text].alias("text"))
    named = named.filter("conv is not null").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)

    counts = named.groupBy("conv", "block").agg(F.count("*").alias("n"))
    starts = counts.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = named.withColumn("own", F.row_number().over(inside)).join(starts, ["conv", "block"])
    placed = placed.withColumn("place", F.col("start") + F.col("own")).drop("start", "own")
    fields = [F.col("place"), F.struct("role", "text", F.col("role").isNull(), F.col("text").isNull())]
    parts = {f"h{k}": F.xxhash64(F.lit(k), *fields).cast("decimal(20,0)") for k in (1, 2)}
    hashed = written(placed.withColumns(parts), "turns")

    sums = hashed.groupBy("conv", "block").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    offsets = sums.select("conv", "block", *[F.coalesce(F.sum(f"s{k}").over(before), zero).cast("decimal(38,0)").alias(f"o{k}") for k in (1, 2)])
    running = {f"h{k}": F.sum(f"h{k}").over(so_far).cast("decimal(38,0)") for k in (1, 2)}
    rolled = hashed.withColumns(running).join(offsets, ["conv", "block"])
    total = {f"h{k}": (F.col(f"h{k}") + F.col(f"o{k}")).cast("decimal(38,0)") for k in (1, 2)}
    return rolled.withColumns(total).select("conv", "turn", "role", "text", "place", "h1", "h2")


def maximal_conversations(rolled: DataFrame) -> DataFrame:
    """``conv, n_turns, n_copies`` of the conversations that are no prefix of a longer one, one of each equal ones."""
    ends = rolled.groupBy("conv").agg(F.max("place").alias("n_turns"))
    with_end = rolled.select("conv", "place", "h1", "h2").join(ends, "conv")
    last = with_end.filter("place = n_turns").groupBy("place", "h1", "h2")
    finals = last.agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = with_end.filter("place < n_turns").select("place", "h1", "h2").distinct()
    return finals.join(inner, ["place", "h1", "h2"], "left_anti").select("conv", F.col("place").alias("n_turns"), "n_copies")


def render(rolled: DataFrame, start: str = START, end: str = END, part_bytes: int = PART_BYTES) -> DataFrame:
    """``conv, part, rendered``: the turns of each conversation in order between markers.

    A part holds the turns that begin within ``part_bytes`` UTF-8 bytes of rendered text, so it is longer by one turn at
    most; part 0 is the whole of a shorter conversation. The parts of one conversation, put together by number (numbers
    that a long turn covers are missing), are its text. Sizes are summed by blocks of places, and no task gathers more
    than one part. Markers inside a text are broken up by a blank, so that no text can open a turn. A null role is
    ``unknown``.
    """
    safe = F.coalesce(F.col("text"), F.lit(""))
    for marker in (start, end):
        safe = F.replace(safe, F.lit(marker), F.lit(f"{marker[:-1]} {marker[-1]}"))
    turn = F.concat(F.lit(start), F.coalesce("role", F.lit("unknown")), F.lit("\n"), safe, F.lit(end + "\n"))
    turns = rolled.select("conv", "place", F.floor((F.col("place") - 1) / BLOCK).alias("block"), turn.alias("turn"))
    turns = turns.withColumn("bytes", F.octet_length("turn").cast("long"))
    sums = turns.groupBy("conv", "block").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = turns.withColumn("sooner", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(starts, ["conv", "block"])
    parts = sized.groupBy("conv", F.floor((F.col("start") + F.col("sooner")) / part_bytes).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "turn")))
    return parts.agg(F.concat_ws("", F.transform(ordered, lambda t: t["turn"])).alias("rendered"))


def collapsed_chats(turns: DataFrame, key: str = "conv_id", part_bytes: int = PART_BYTES, **columns: str) -> DataFrame:
    """Per conversation that stays: key, ``n_turns``, ``n_copies`` (equal ones, itself included), ``part``, ``rendered``.

    A conversation of more than ``part_bytes`` has a row for each part (:func:`render`), any other has one. Empty tables
    give no rows; columns other than the four named ones are not read.
    """
    rolled = written(rolling_hashes(turns, key, **columns), "rolled")
    stay = written(maximal_conversations(rolled), "maximal")
    texts = render(rolled.join(stay.select("conv"), "conv", "left_semi"), part_bytes=part_bytes)
    counts = [F.col("n_turns").cast("long").alias("n_turns"), "n_copies"]
    return stay.join(texts, "conv").select(F.col("conv").alias(key), *counts, "part", "rendered")
