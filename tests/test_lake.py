import datetime
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.registry.staging import new_table
from tickloom.session import shared_dir
from tickloom.sources import lake

DAY = datetime.date
ROWS = [
    (1, 1.0, "a", DAY(2024, 1, 1)),
    (2, None, "a", DAY(2024, 1, 1)),
    (3, 3.0, "a", DAY(2024, 1, 2)),
    (4, 4.0, "it's", DAY(2024, 1, 1)),
    (5, 5.0, None, DAY(2024, 1, 2)),
]
SCHEMA = "id int, price double, asset string, day date"
PARTS = ["asset", "day"]


@pytest.fixture
def table(spark):
    name = new_table(spark, "t")
    lake.insert_to_table(spark.createDataFrame(ROWS, SCHEMA), name, {}, PARTS)
    return name


def ids(spark, name):
    return sorted(row["id"] for row in spark.table(name).collect())


def test_partition_columns_round_trip_with_nulls(spark, table):
    assert sorted(map(tuple, spark.table(table).collect()), key=str) == sorted(ROWS, key=str)
    assert lake.partition_columns(spark, table) == PARTS


def test_overwrite_partitions_replaces_only_those_present(spark, table):
    lake.insert_to_table(spark.createDataFrame([(9, 9.0, "a", DAY(2024, 1, 1))], SCHEMA), table, {}, PARTS)
    assert ids(spark, table) == [3, 4, 5, 9]


def test_append_and_overwrite(spark, table):
    row = spark.createDataFrame([(9, 9.0, "a", DAY(2024, 1, 1))], SCHEMA)
    lake.insert_to_table(row, table, {}, PARTS, mode="append")
    assert ids(spark, table) == [1, 2, 3, 4, 5, 9]
    lake.insert_to_table(row, table, {}, PARTS, mode="overwrite")
    assert ids(spark, table) == [9]


def test_columns_go_by_name(spark, table):
    shuffled = spark.createDataFrame([(DAY(2024, 2, 1), "b", 7, 7.5)], "day date, asset string, id int, price double")
    lake.insert_to_table(shuffled, table, {}, PARTS, mode="append")
    assert spark.table(table).filter("id = 7").first()["price"] == 7.5


def test_a_value_that_does_not_cast_stops_the_write(spark, table):
    bad = spark.createDataFrame([("x", 1.0, "a", DAY(2024, 1, 1))], "id string, price double, asset string, day date")
    with pytest.raises(PySparkException):
        lake.insert_to_table(bad, table, {"id": "int"}, PARTS)
    with pytest.raises(ValueError):
        lake.insert_to_table(bad, table, {"absent": "int"}, PARTS)
    with pytest.raises(ValueError):
        lake.insert_to_table(bad, table, {}, PARTS, mode="merge")
    assert ids(spark, table) == [1, 2, 3, 4, 5]


def test_overwrite_of_more_than_a_hundred_partitions_keeps_all(spark):
    name = new_table(spark, "many")
    rows = spark.range(600).select(F.col("id"), (F.col("id") % 150).alias("part"))
    lake.insert_to_table(rows, name, {}, ["part"], mode="overwrite")
    assert spark.table(name).count() == 600 and spark.table(name).select("part").distinct().count() == 150


def test_delete_keeps_rows_with_unknown_condition(spark, table):
    lake.delete_rows(spark, table, ["price > 0", "asset = 'a'"])
    assert ids(spark, table) == [2, 4, 5]


def test_deleted_partitions_are_gone_and_do_not_come_back(spark, table):
    lake.delete_rows(spark, table, ["day = DATE '2024-01-01'"])
    assert ids(spark, table) == [3, 5]
    assert spark.sql(f"SHOW PARTITIONS {table}").count() == 2
    lake.insert_to_table(spark.createDataFrame([(9, 9.0, "it's", DAY(2024, 1, 1))], SCHEMA), table, {}, PARTS, mode="append")
    assert ids(spark, table) == [3, 5, 9]


def test_delete_in_a_null_partition(spark, table):
    lake.delete_rows(spark, table, ["id = 5"])
    assert ids(spark, table) == [1, 2, 3, 4]
    assert spark.sql(f"SHOW PARTITIONS {table}").count() == 3


def test_delete_reads_only_the_partitions_it_rewrites(spark, table):
    tuples = spark.createDataFrame([("a", DAY(2024, 1, 2))], "asset string, day date")
    plan = lake._within(spark.table(table), tuples, PARTS)._jdf.queryExecution().executedPlan().toString()
    assert "asset" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_delete_insert_replaces_and_adds(spark, table):
    new = spark.createDataFrame([(1, 10.0, "a", DAY(2024, 1, 1)), (8, 8.0, "new", DAY(2024, 3, 1))], SCHEMA)
    lake.delete_insert(new, table, ["asset = 'a'"])
    assert ids(spark, table) == [1, 4, 5, 8]
    assert spark.table(table).filter("id = 1").first()["price"] == 10.0
    assert ("a", DAY(2024, 1, 2)) not in {(r["asset"], r["day"]) for r in spark.table(table).collect()}


def test_delete_insert_keeps_other_rows_of_partitions_it_only_adds_to(spark, table):
    lake.delete_insert(spark.createDataFrame([(9, 9.0, "a", DAY(2024, 1, 1))], SCHEMA), table, ["id = 3"])
    assert ids(spark, table) == [1, 2, 4, 5, 9]


def test_unpartitioned_tables(spark):
    name = new_table(spark, "flat")
    lake.insert_to_table(spark.createDataFrame(ROWS, SCHEMA), name, {}, [])
    lake.delete_insert(spark.createDataFrame([(9, 9.0, "z", None)], SCHEMA), name, ["price >= 4"])
    assert ids(spark, name) == [1, 2, 3, 9]
    lake.delete_rows(spark, name, ["id = 1"])
    assert ids(spark, name) == [2, 3, 9]


def test_a_condition_is_required(spark, table):
    with pytest.raises(ValueError):
        lake.delete_rows(spark, table, [])
    assert ids(spark, table) == [1, 2, 3, 4, 5]


def test_a_delete_that_matches_nothing_changes_nothing(spark, table):
    lake.delete_rows(spark, table, ["id = 99"])
    assert ids(spark, table) == [1, 2, 3, 4, 5]


def test_delete_all_keeps_the_table(spark, table):
    lake.delete_all(spark, table)
    assert ids(spark, table) == [] and spark.table(table).columns == ["id", "price", "asset", "day"]


def test_aggregate_to_table_modes_and_statistics(spark, table):
    target = new_table(spark, "agg")
    text = f"SELECT asset, count(1) AS n FROM {table} WHERE id >= :least GROUP BY asset"
    stats = lake.aggregate_to_table(spark, text, target, args={"least": 1}, sources=[spark.table(table)])
    assert stats.rows == 3 and stats.runtime_s > 0 and stats.scanned_mb > 0
    lake.aggregate_to_table(spark, text, target, mode="append", args={"least": 4})
    assert spark.table(target).count() == 5
    lake.aggregate_to_table(spark, text, target, mode="delete_insert", args={"least": 4})
    assert spark.table(target).count() == 2
    with pytest.raises(ValueError):
        lake.aggregate_to_table(spark, text, target, mode="replace")


def test_the_session_setting_is_restored(spark, table):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    lake.delete_rows(spark, table, ["id = 1"])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_the_shared_folder_is_the_one_named_in_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert uuid.uuid4().hex not in shared_dir(spark)


def test_columns_the_table_does_not_have_are_an_error(spark):
    from tickloom.registry.staging import new_table

    name = new_table(spark, "strict")
    rows = spark.createDataFrame([(1, "a")], "id long, part string")
    lake.insert_to_table(rows, name, {"id": "bigint"}, ["part"])
    with pytest.raises(ValueError, match="extra"):
        lake.insert_to_table(rows.selectExpr("*", "1 as extra"), name, {"id": "bigint"}, ["part"], mode="append")
    with pytest.raises(ValueError, match="extra"):
        lake.delete_insert(rows.selectExpr("*", "1 as extra"), name, ["id = 1"])
    assert spark.table(name).count() == 1


def test_threads_of_one_session_do_not_share_an_overwrite_mode(spark, table):
    other = new_table(spark, "t")
    lake.insert_to_table(spark.createDataFrame(ROWS, SCHEMA), other, {}, PARTS)
    row = spark.createDataFrame([(9, 9.0, "a", DAY(2024, 1, 1))], SCHEMA)

    def write(number):
        mode = "overwrite" if number % 2 else "overwrite_partitions"
        lake.insert_to_table(row, other if number % 2 else table, {}, PARTS, mode=mode)

    with ThreadPoolExecutor(4) as threads:
        list(threads.map(write, range(8)))
    assert ids(spark, table) == [3, 4, 5, 9] and ids(spark, other) == [9]


def _failing(step):
    def fail(*args, **kwargs):
        raise RuntimeError(step)

    return fail


@pytest.mark.parametrize("step", ["_partition_paths", "_move_partitions", "_changed"])
@pytest.mark.parametrize("conditions", [["day = DATE '2024-01-01'"], ["price > 0", "asset = 'a'"]])
def test_a_failure_before_the_move_leaves_the_old_rows(spark, table, monkeypatch, step, conditions):
    new = spark.createDataFrame([(8, 8.0, "a", DAY(2024, 1, 1)), (9, 9.0, "new", DAY(2024, 3, 1))], SCHEMA)
    monkeypatch.setattr(lake, step, _failing(step))
    with pytest.raises(RuntimeError, match=step):
        lake.delete_insert(new, table, conditions)
    assert sorted(map(tuple, spark.table(table).collect()), key=str) == sorted(ROWS, key=str)
    monkeypatch.undo()
    lake.delete_insert(new, table, conditions)
    gone = {1, 2, 4} if len(conditions) == 1 else {1, 3}
    assert ids(spark, table) == sorted({1, 2, 3, 4, 5} - gone | {8, 9})


def test_whole_partitions_are_replaced_without_reading_any(spark, table):
    """The old files are unreadable, so a read of one of them would fail."""
    with pytest.raises(Exception):
        folder = lake._location(spark, table).removeprefix("file:")
        for path in Path(folder).rglob("*.parquet"):
            path.write_bytes(b"broken")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        spark.table(table).collect()
    new = spark.createDataFrame([(8, 8.0, "a", DAY(2024, 1, 1))], SCHEMA)
    lake.delete_insert(new, table, ["day >= DATE '2024-01-01'"])
    assert ids(spark, table) == [8]


def test_all_writes_go_on_after_partitions_were_moved(spark, table):
    row = lambda i, asset, day: spark.createDataFrame([(i, 1.0, asset, DAY(2024, 1, day))], SCHEMA)
    lake.delete_rows(spark, table, ["id = 1"])
    lake.insert_to_table(row(10, "a", 1), table, {}, PARTS, mode="append")
    assert ids(spark, table) == [2, 3, 4, 5, 10]
    lake.insert_to_table(row(11, "a", 1), table, {}, PARTS)
    assert ids(spark, table) == [3, 4, 5, 11]
    lake.delete_insert(row(12, "it's", 1), table, ["id = 4"])
    lake.delete_insert(row(13, None, 2), table, ["id = 3"])
    assert ids(spark, table) == [5, 11, 12, 13]
    versions = Path(lake._location(spark, table).removeprefix("file:")) / "_versions"
    assert sum(1 for _ in versions.rglob("*.parquet")) <= 5
    lake.insert_to_table(row(14, "z", 1), table, {}, PARTS, mode="overwrite")
    assert ids(spark, table) == [14]
    lake.delete_all(spark, table)
    lake.insert_to_table(row(15, "a", 1), table, {}, PARTS, mode="append")
    assert ids(spark, table) == [15]
    spark.sql(f"DROP TABLE {table}")
    assert not versions.exists()


def test_odd_partition_values_survive_a_move(spark):
    name = new_table(spark, "odd")
    values = ["a/b", "50%", "x=y", "it's", "ü", "a b", "q?", "[x]", "{a}", "\\\\", "#1", ":", None]
    frame = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(values)] + [(100 + i, v, 3) for i, v in enumerate(values)], "id int, v string, n int")
    lake.insert_to_table(frame, name, {}, ["v", "n"])
    lake.delete_rows(spark, name, ["id >= 100", "id < 200"])
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == sorted(((i, v, i % 2) for i, v in enumerate(values)), key=str)
    lake.delete_insert(frame.filter("id >= 100"), name, ["n = 0"])
    assert ids(spark, name) == sorted([i for i in range(len(values)) if i % 2] + [100 + i for i in range(len(values))])
