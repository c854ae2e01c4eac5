"""What the plans must look like to hold at scale."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import keyed, pnl, positions, shaping
from tickloom.operators import ticks as t
from tickloom.plans import model_weights
from tickloom.registry import views
from tickloom.session import broadcast_if_small, shared_dir, written_counted

SMALL = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_latest_ticks_limit_groups_before_the_shuffle(spark):
    text = plan(t.latest_moves(views.ticks(spark, SMALL), 15))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark):
    income = views.income(spark, SMALL)
    text = plan(pnl.total_pnl(income, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text and "EqualTo" not in text.split("ReadSchema")[1]
    assert "props" not in text


def test_top_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(shaping.latest_rows(views.ticks(spark, SMALL), ["id"], 2000))


def test_newest_items_are_found_without_sorting_the_puts(spark, monkeypatch):
    puts, keys, order = views.kv_puts(spark, SMALL), ["asset", "model_type"], ["updated_at", "seq"]
    plans = []
    monkeypatch.setattr(keyed, "written_counted", lambda frame, label: plans.append(plan(frame)) or written_counted(frame, label))
    text = plan(keyed.latest_per_key(puts, keys, order))
    # The moments: a hash aggregate that combines before its shuffle.
    assert plans[0].count("HashAggregate") == 2 and "partial_max" in plans[0] and "Sort" not in plans[0]
    # The items: only rows that match such a moment are shuffled and aggregated.
    assert "Window" not in text and text.count("Exchange hashpartitioning") == 1
    assert text.index("SortAggregate") < text.index("BroadcastHashJoin") and "Sort" not in text[text.index("BroadcastHashJoin") :]


def test_a_guarded_select_runs_once_and_counts_in_all_tasks(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(shaping, "written_counted", lambda frame, label: runs.append(plan(frame)) or written_counted(frame, label))
    spark.range(50).createOrReplaceTempView("guarded_rows")
    found = shaping.guarded_select(spark, "SELECT id, rand() AS r FROM guarded_rows ORDER BY id DESC", limit=50)
    assert len(runs) == 1 and "SinglePartition" not in runs[0] + plan(found) and "Limit" not in runs[0]
    rows = found.collect()
    assert [row.id for row in rows] == list(range(49, -1, -1)) and rows == found.collect()
    for limit in (3, 20):
        with pytest.raises(ValueError, match=f"more than {limit} rows"):
            shaping.guarded_select(spark, "SELECT id FROM guarded_rows", limit=limit)


def test_stops_are_planned_without_cross_joins_or_python(spark):
    held, orders = views.positions(spark, SMALL), views.open_orders(spark, SMALL)
    for frame in (positions.trailing_decisions(held, orders), positions.missing_stops(held, orders)):
        text = plan(frame)
        for unwanted in ("NestedLoop", "CartesianProduct", "Python", "Generate explode(sequence"):
            assert unwanted not in text


def test_predictions_are_not_shuffled_for_the_recent_weights(spark):
    ticks, predictions = views.ticks(spark, SMALL), views.predictions(spark, SMALL)
    text = plan(model_weights.recent_weights(ticks, predictions, views.AS_OF, 1, 15))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_only_a_counted_small_side_is_broadcast(spark):
    big, small = spark.range(100_000), spark.range(11)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(big.join(broadcast_if_small(small, 11), "id"))
        assert "BroadcastHashJoin" not in plan(big.join(broadcast_if_small(small, 10), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster())


def test_the_date_filter_prunes_partitions(spark):
    path = shared_dir(spark) + "/dated"
    views.ticks(spark, SMALL).write.mode("overwrite").partitionBy("scraped_date").parquet(path)
    text = plan(shaping.since(spark.read.parquet(path), "scraped_date", views.AS_OF, 1).agg(F.sum("price")))
    assert "scraped_date" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    held, orders = views.positions(spark, SMALL), views.open_orders(spark, SMALL)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (positions.trailing_decisions(held, orders), positions.missing_stops(held, orders)):
            code = debug.codegenString(frame._jdf.queryExecution().executedPlan())
            assert max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
