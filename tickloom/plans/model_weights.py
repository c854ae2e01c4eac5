"""Model weights: how often each model foresaw the next price move, as shares per asset."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scoring import accuracies, judged, weights
from tickloom.operators.shaping import since
from tickloom.operators.ticks import all_moves, label_moves, latest_moves
from tickloom.session import broadcast_if_small, written
from tickloom.sources.lake import insert_to_table

# The stored types of a weight.
WEIGHT_SCHEMA = {
    "model_type": "string",
    "asset": "string",
    "corrected_prediction": "int",
    "total_predicted": "int",
    "accuracy": "float",
    "weight": "float",
}
WEIGHT_PARTITIONS = ["asset"]
# A tick takes some 50 bytes, so this stays near 10 MB.
MAX_BROADCAST_TICKS = 200_000
_TICK = ("id", "asset", "scraped_timestamp", "scraped_date", "price")


def recent_weights(
    ticks: DataFrame, predictions: DataFrame, as_of: date, days: int, count: int, asset: str | None = None
) -> DataFrame:
    """Weights from the newest ``count`` ticks of the last ``days`` days, for one asset or for all at once.

    The look-back prunes date partitions of both inputs. The evaluated ticks, ``count`` per asset, are written
    and counted; up to ``MAX_BROADCAST_TICKS`` of them are broadcast, so that the predictions are filtered and
    probed where they are read.
    """
    ticks = since(ticks.select(*_TICK), "scraped_date", as_of, days)
    predictions = since(predictions, "predicted_date", as_of, days)
    if asset is not None:
        ticks, predictions = ticks.filter(F.col("asset") == asset), predictions.filter(F.col("asset") == asset)
    evaluated = written(label_moves(latest_moves(ticks, count)), "evaluated")
    return weights(accuracies(judged(broadcast_if_small(evaluated, MAX_BROADCAST_TICKS), predictions)))


def history_weights(ticks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Weights from every tick there is."""
    moves = all_moves(ticks.select("id", "asset", "scraped_timestamp", "price"))
    return weights(accuracies(judged(label_moves(moves), predictions)))


def store_weights(result: DataFrame, table: str) -> None:
    """Replace the stored weights of the assets in ``result``; other assets keep theirs."""
    insert_to_table(result, table, WEIGHT_SCHEMA, WEIGHT_PARTITIONS)
