"""Scoring of predictions against later price moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numbers import whole


def known_predictions(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """Predictions whose tick is among the evaluated ones."""
    return predictions.join(actual.select(F.col("id").alias("raw_data_id")), "raw_data_id", "left_semi")


def judged(actual: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per (tick, prediction): rounded prediction, correct or wrong, buy or sell.

    Ticks without a label and predictions without a value drop out before the join, which makes the left join
    of the two an inner join.
    """
    rounded = whole(F.col("raw_prediction"))
    labelled = actual.dropna(subset=["true_result"]).select("id", "asset", "true_result")
    given = predictions.dropna(subset=["prediction"]).select(
        F.col("raw_data_id").alias("id"), "model_type", F.col("prediction").alias("raw_prediction")
    )
    return labelled.join(given, "id").select(
        F.when(F.col("true_result") == rounded, "correct").otherwise("wrong").alias("result"),
        F.when(rounded == 0, "sell").when(rounded == 1, "buy").alias("signal"),
        rounded.cast("int").alias("prediction"),
        *["asset", "model_type", "id", "true_result"],
    )


def accuracies(rows: DataFrame) -> DataFrame:
    """Correct and total predictions per model and asset in one pass; models never right drop out."""
    return (
        rows.groupBy("model_type", "asset")
        .agg(
            F.count_if(F.col("result") == "correct").alias("corrected_prediction"),
            F.count(F.lit(1)).alias("total_predicted"),
        )
        .filter(F.col("corrected_prediction") > 0)
        .withColumn("accuracy", F.col("corrected_prediction").cast("double") / F.col("total_predicted").cast("double"))
    )


def weights(accuracy: DataFrame) -> DataFrame:
    """Share of each model in the summed accuracy of its asset. One input row per model and asset."""
    total = F.sum("accuracy").over(Window.partitionBy("asset"))
    return accuracy.withColumn("weight", F.col("accuracy") / total)
