"""Message and path texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of a signal message, spaces and newlines included.
MESSAGE_HEAD = "asset: "
BLOCK_MODEL = "\n        model: "
BLOCK_SIGNAL = "\n        signal: "
BLOCK_END = "\n        ---------------\n        "


def signal_block(model: Column, signal: Column) -> Column:
    return F.concat(F.lit(BLOCK_MODEL), model, F.lit(BLOCK_SIGNAL), signal, F.lit(BLOCK_END))


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def with_prefix(path: Column, old: str, new: str) -> Column:
    """``path`` with the leading ``old`` replaced by ``new``; other paths unchanged."""
    moved = F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))
    return F.when(path.startswith(old), moved).otherwise(path)
