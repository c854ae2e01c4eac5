"""Moves, labels, scoring, weights, bars, messages, profit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import messages, pnl, scoring
from tickloom.operators import ticks as t
from tickloom.plans import model_weights
from tickloom.registry import views
from tickloom.registry.book import query
from tickloom.registry.views import AS_OF, with_views
from tickloom.session import written

RECENT = f"""select *, lag(price) over (partition by asset order by scraped_timestamp desc, id desc) - price as diff,
    row_number() over (partition by asset order by scraped_timestamp desc, id desc) as rn
    from ticks where scraped_date >= date '{AS_OF}' - 1"""
EVERY = "select *, lag(price) over (partition by asset order by scraped_timestamp desc, id desc) - price as diff from ticks"
LABEL = "case when diff > 0 then 1 when diff < 0 then 0 end as true_result"
JUDGED = """select asset, model_type, id, true_result, cast(guess as integer) as prediction,
    ['sell', 'buy'][cast(guess as integer) + 1] as signal, if(guess = true_result, 'correct', 'wrong') as result
    from (select raw_data_id, model_type, round(prediction) as guess from predictions) g join actual on actual.id = g.raw_data_id
    where guess + true_result is not null"""
ACCURACY = """select *, corrected_prediction / total_predicted as accuracy from (
    select asset, model_type, count(*) as total_predicted, count(*) filter (where result = 'correct') as corrected_prediction
    from judged group by asset, model_type) where corrected_prediction > 0"""
WEIGHT = """select * replace (round(accuracy, 9) as accuracy), round(accuracy / sum(accuracy) over (partition by asset), 9) as weight
    from accuracy"""


def _weights_sql(moves: str, keep: str, weight: str = WEIGHT) -> str:
    return with_views(
        "ticks predictions",
        f""", moves as ({moves}), actual as (select *, {LABEL} from moves where {keep}),
        judged as ({JUDGED}), accuracy as ({ACCURACY}) {weight}""",
    )


def _rounded(weights):
    return weights.withColumns({"accuracy": F.round("accuracy", 9), "weight": F.round("weight", 9)})


@query("w1_price_move_latest", with_views("ticks", f", moves as ({RECENT}) select id, asset, scraped_timestamp, price, diff from moves where rn <= 15"))
def price_move_latest(spark, folder):
    recent = views.ticks(spark, folder).filter(F.col("scraped_date") >= F.date_sub(F.lit(AS_OF), 1))
    return t.latest_moves(recent, 15).select("id", "asset", "scraped_timestamp", "price", "diff")


@query("w1_price_move_history", with_views("ticks", f" select id, asset, scraped_timestamp, price, diff from ({EVERY})"))
def price_move_history(spark, folder):
    return t.all_moves(views.ticks(spark, folder).select("id", "asset", "scraped_timestamp", "price"))


@query(
    "w1_price_move_with_ties",
    with_views(
        "ticks",
        """, coarse as (select id, asset, date_trunc('minute', scraped_timestamp) as scraped_timestamp, price from ticks)
        select *, lag(price) over (partition by asset order by scraped_timestamp desc, id desc) - price as diff from coarse""",
    ),
)
def price_move_with_ties(spark, folder):
    coarse = views.ticks(spark, folder).select(
        "id", "asset", F.date_trunc("minute", "scraped_timestamp").cast("timestamp_ntz").alias("scraped_timestamp"), "price"
    )
    return t.all_moves(coarse)


@query(
    "w2_latest_ticks",
    with_views(
        "ticks",
        """ select id, asset, scraped_timestamp, price from (select *, row_number() over
        (partition by asset order by scraped_timestamp desc, id desc) as rn from ticks) where rn <= 15""",
    ),
)
def latest_ticks(spark, folder):
    return t.latest_ticks(views.ticks(spark, folder).select("id", "asset", "scraped_timestamp", "price"), 15)


@query("p9_move_labels", with_views("ticks", f", moves as ({EVERY}) select id, asset, diff, {LABEL} from moves"))
def move_labels(spark, folder):
    return t.label_moves(price_move_history(spark, folder)).select("id", "asset", "diff", "true_result")


@query(
    "j1_actual_with_prediction",
    with_views("ticks predictions", f", moves as ({EVERY}), actual as (select *, {LABEL} from moves) {JUDGED}"),
)
def actual_with_prediction(spark, folder):
    return scoring.judged(t.label_moves(price_move_history(spark, folder)), views.predictions(spark, folder))


@query(
    "j2_predictions_of_evaluated_ticks",
    with_views(
        "ticks predictions",
        f""", moves as ({RECENT}) select asset, raw_data_id, model_type, prediction, predicted_timestamp from predictions p
        where exists (select 1 from moves m where m.rn <= 15 and m.id = p.raw_data_id)""",
    ),
)
def predictions_of_evaluated_ticks(spark, folder):
    known = scoring.known_predictions(views.predictions(spark, folder), price_move_latest(spark, folder))
    return known.select("asset", "raw_data_id", "model_type", "prediction", "predicted_timestamp")


@query(
    "j3_correct_counts_with_totals",
    with_views("ticks predictions", f", moves as ({EVERY}), actual as (select *, {LABEL} from moves), judged as ({JUDGED}) {ACCURACY}"),
)
def correct_counts_with_totals(spark, folder):
    """Totals joined to the counts that are not zero: the rows are counted once, and the small counts are joined."""
    keys = ["model_type", "asset"]
    right = F.count_if(F.col("result") == "correct").alias("corrected_prediction")
    rows = actual_with_prediction(spark, folder).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_predicted"), right)
    counts = written(rows, "counts")
    totals = counts.select(*keys, "total_predicted")
    correct = counts.select(*keys, "corrected_prediction").filter("corrected_prediction > 0")
    accuracy = F.col("corrected_prediction").cast("double") / F.col("total_predicted").cast("double")
    return correct.join(totals, keys, "left").withColumn("accuracy", accuracy)


@query(
    "j4_share_of_total",
    with_views(
        "ticks predictions",
        f""", moves as ({EVERY}), actual as (select *, {LABEL} from moves), judged as ({JUDGED}), accuracy as ({ACCURACY})
        select model_type, asset, round(accuracy / total, 9) as weight
        from accuracy cross join (select sum(accuracy) as total from accuracy)""",
    ),
)
def share_of_total(spark, folder):
    """Share in the sum over everything: the total is a scalar subquery, so nothing is joined."""
    accuracy = scoring.accuracies(actual_with_prediction(spark, folder))
    total = accuracy.agg(F.sum("accuracy")).scalar()
    return accuracy.select("model_type", "asset", F.round(F.col("accuracy") / total, 9).alias("weight"))


@query(
    "a1_predictions_per_model",
    with_views(
        "ticks predictions",
        f""", moves as ({EVERY}), actual as (select *, {LABEL} from moves), judged as ({JUDGED})
        select model_type, asset, count(1) as total_predicted from judged group by all""",
    ),
)
def predictions_per_model(spark, folder):
    rows = actual_with_prediction(spark, folder)
    return rows.groupBy("model_type", "asset").agg(F.count(F.lit(1)).alias("total_predicted"))


@query(
    "a2_correct_per_model",
    with_views(
        "ticks predictions",
        f""", moves as ({EVERY}), actual as (select *, {LABEL} from moves), judged as ({JUDGED})
        select model_type, asset, count(1) as corrected_prediction from judged where result = 'correct' group by all""",
    ),
)
def correct_per_model(spark, folder):
    counted = scoring.accuracies(actual_with_prediction(spark, folder))
    return counted.select("model_type", "asset", "corrected_prediction")


@query(
    "a3_accuracy_per_model",
    with_views("ticks predictions", f", moves as ({EVERY}), actual as (select *, {LABEL} from moves), judged as ({JUDGED}) {ACCURACY}"),
)
def accuracy_per_model(spark, folder):
    return scoring.accuracies(actual_with_prediction(spark, folder))


@query("a4_model_weights_history", _weights_sql(EVERY, "true"))
def model_weights_history(spark, folder):
    return _rounded(model_weights.history_weights(views.ticks(spark, folder), views.predictions(spark, folder)))


@query("model_weights_recent", _weights_sql(RECENT, "rn <= 15"))
def model_weights_recent(spark, folder):
    return _rounded(
        model_weights.recent_weights(views.ticks(spark, folder), views.predictions(spark, folder), AS_OF, 1, 15)
    )


@query("model_weights_recent_one_asset", _weights_sql(RECENT, "rn <= 15 and asset = 'purchase'"))
def model_weights_recent_one_asset(spark, folder):
    ticks, predictions = views.ticks(spark, folder), views.predictions(spark, folder)
    return _rounded(model_weights.recent_weights(ticks, predictions, AS_OF, 1, 15, asset="purchase"))


@query(
    "w3_share_of_asset_total",
    with_views(
        "ticks",
        " select asset, scraped_date, round(day_sum / sum(day_sum) over (partition by asset), 9) as share"
        " from (select asset, scraped_date, sum(price) as day_sum from ticks group by all)",
    ),
)
def share_of_asset_total(spark, folder):
    days = views.ticks(spark, folder).groupBy("asset", "scraped_date").agg(F.sum("price").alias("day_sum"))
    share = F.col("day_sum") / F.sum("day_sum").over(Window.partitionBy("asset"))
    return days.select("asset", "scraped_date", F.round(share, 9).alias("share"))


START, END = datetime(2024, 1, 10, 6), datetime(2024, 1, 20, 18, 30, 15, 250_000)


@query(
    "a5_realized_pnl_in_range",
    with_views(
        "income",
        f""" select round(coalesce(sum(income), 0), 6) as pnl from income where income_type = 'REALIZED_PNL'
        and epoch_us(income_time) // 1000 between epoch_us(timestamp '{START}') // 1000 and epoch_us(timestamp '{END}') // 1000""",
    ),
)
def realized_pnl_in_range(spark, folder):
    return pnl.total_pnl(views.income(spark, folder), START, END).select(F.round("pnl", 6).alias("pnl"))


@query(
    "a5_realized_pnl_today",
    with_views(
        "income",
        """ select round(coalesce(sum(income), 0), 6) as pnl from income where income_type = 'REALIZED_PNL'
        and income_time >= timestamp '2024-01-30' and epoch_us(income_time) // 1000 <= epoch_us(timestamp '2024-01-30 21:00:00') // 1000""",
    ),
)
def realized_pnl_today(spark, folder):
    start, end = pnl.bounds(None, None, now=datetime(2024, 1, 30, 21))
    return pnl.total_pnl(views.income(spark, folder), start, end).select(F.round("pnl", 6).alias("pnl"))


DAILY = with_views(
    "income",
    """ select cast(income_time as date) as day, symbol, round(sum(income), 6) as pnl, count(1) as entries
    from income where income_type = 'REALIZED_PNL' group by all""",
)


@query("a5_daily_pnl", DAILY)
def daily_pnl(spark, folder):
    return pnl.daily_pnl(views.income(spark, folder)).withColumn("pnl", F.round("pnl", 6))


@query(
    "a7_signal_messages",
    with_views(
        "predictions signals",
        """ select asset, notice, 'asset: ' || asset || string_agg(
        chr(10) || '        model: ' || model || chr(10) || '        signal: ' || signal || chr(10) ||
        '        ---------------' || chr(10) || '        ', '' order by ord) as body
        from signals group by asset, notice""",
    ),
)
def signal_messages(spark, folder):
    return messages.message_bodies(views.signals(spark, folder))


@query(
    "a8_bars",
    with_views(
        "ticks",
        """ select asset, epoch_ms(slot) as open_time, epoch_ms(slot) + 899999 as close_time,
        arg_min(price, id) as open, max(price) as high, min(price) as low, arg_max(price, id) as close,
        cast(count(1) as double) as volume, count(1) as number_of_trades
        from (select *, time_bucket(interval 15 minutes, scraped_timestamp) as slot from ticks) group by asset, slot""",
    ),
)
def price_bars(spark, folder):
    return t.bars(views.ticks(spark, folder))
