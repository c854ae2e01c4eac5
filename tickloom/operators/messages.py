"""Signal messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import MESSAGE_HEAD, signal_block


def message_bodies(signals: DataFrame) -> DataFrame:
    """One message per (asset, notice) with a block for each model, in the order of ``ord``.

    ``notice`` is the event being reported; a message holds as many blocks as there are models, so groups
    stay small however many events an asset has.
    """
    blocks = signals.withColumn("block", signal_block(F.col("model"), F.col("signal")))
    body = F.expr("listagg(block, '') within group (order by ord)")
    return blocks.groupBy("asset", "notice").agg(
        F.concat(F.lit(MESSAGE_HEAD), F.col("asset"), body).alias("body")
    )
