import datetime
import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators.shaping import guarded_select, run_statements, statement_text
from tickloom.registry.staging import jdbc_url, new_table
from tickloom.session import scratch_path
from tickloom.sources import klines, landing, relational

BAR = [1704067200000, "1.0", "2.0", "0.5", "1.5", "10", 1704070799999, "15", 3, "5", "7.5", "0"]


def payloads(spark, *pairs):
    rows = [(asset, "t0", body if isinstance(body, str) else json.dumps(body)) for asset, body in pairs]
    return spark.createDataFrame(rows, "asset string, scraped_time string, payload string")


def changed(position, value):
    return [value if i == position else item for i, item in enumerate(BAR)]


def test_bars_are_named_and_typed(spark):
    row = klines.typed_bars(payloads(spark, ("A", [BAR]))).collect()
    assert len(row) == 1 and row[0]["open"] == 1.0 and row[0]["number_of_trades"] == 3 and row[0]["ignore"] == "0"
    assert row[0]["asset"] == "A" and row[0]["scraped_time"] == "t0"


@pytest.mark.parametrize(
    "body",
    [
        [BAR, changed(1, "n/a")],
        [BAR, changed(8, None)],
        [BAR, changed(0, "1.5x")],
        [BAR, BAR[:-1]],
        [BAR, BAR + ["more"]],
        [BAR, None],
        "not json",
        '{"code": -1121}',
    ],
)
def test_one_flaw_rejects_the_asset_and_no_other(spark, body):
    frame = payloads(spark, ("good", [BAR, BAR]), ("bad", body))
    good, quarantined = klines.split_by_health(klines.parse_bars(frame))
    assert [r["asset"] for r in good.collect()] == ["good", "good"]
    assert {r["asset"] for r in quarantined.collect()} == {"bad"}


def test_a_missing_float_is_no_flaw(spark):
    row = klines.typed_bars(payloads(spark, ("A", [changed(1, None)]))).collect()
    assert len(row) == 1 and row[0]["open"] is None


def test_an_empty_payload_has_no_bars(spark):
    assert klines.typed_bars(payloads(spark, ("A", []))).collect() == []


def test_nothing_sound_gives_an_empty_frame_with_its_schema(spark):
    result = klines.typed_bars(payloads(spark, ("A", "x"), ("B", "y")))
    assert result.collect() == [] and result.columns == [*klines.BAR_TYPES, "scraped_time", "asset"]


def test_capture_wise_isolation(spark):
    frame = payloads(spark, ("A", [BAR]), ("A", [changed(1, "n/a")]))
    frame = frame.withColumn("scraped_time", F.when(F.col("payload").contains("n/a"), "t1").otherwise("t0"))
    assert len(klines.typed_bars(frame, unit=("asset", "scraped_time")).collect()) == 1
    assert klines.typed_bars(frame).collect() == []


def test_captured_files_are_read_whole(spark, tmp_path):
    (tmp_path / "A_B_20240131_235959.json").write_text(json.dumps([BAR, changed(1, "3.25")], indent=2))
    (tmp_path / "C_20240101_000000.json").write_text("{}")
    good, rejected = klines.split_by_health(klines.parse_bars(klines.read_captures(spark, str(tmp_path))))
    rows = good.collect()
    assert sorted(r["open"] for r in rows) == [1.0, 3.25]
    assert {(r["asset"], str(r["scraped_time"])) for r in rows} == {("A_B", "2024-01-31 23:59:59")}
    assert [r["asset"] for r in rejected.collect()] == ["C"]


def test_written_captures_come_back_with_their_names(spark):
    rows = [("BTC_X/y+z %41", datetime.datetime(2024, 1, 1, 2, 3, 4), "[[1]]\n[2]"), ("é=1", datetime.datetime(2024, 1, 1), "x")]
    folder = scratch_path(spark, "captures")
    klines.write_captures(spark.createDataFrame(rows, "asset string, scraped_time timestamp_ntz, payload string"), folder)
    got = [(r.asset, r.scraped_time, r.payload.rstrip("\n")) for r in klines.read_captures(spark, folder).collect()]
    assert sorted(got) == sorted(rows)


def test_files_with_other_names_are_quarantined(spark, tmp_path):
    for name in ("A_20240131_235959.json", "A_late.json", "notes.json", "A_20241331_000000.json"):
        (tmp_path / name).write_text(json.dumps([BAR]))
    (tmp_path / "empty.json").write_text("[]")
    for unit in (("asset",), ("asset", "scraped_time")):
        good, rejected = klines.split_by_health(klines.parse_bars(klines.read_captures(spark, str(tmp_path))), unit)
        assert [r["asset"] for r in good.collect()] == ["A"]
        assert sorted(r["asset"] for r in rejected.collect()) == ["A_20241331_000000.json", "A_late.json", "empty.json", "notes.json"]


RECORD = {"timestamp": "2024-01-01 00:00:05", "asset": "A", "price": "1.5", "source_id": 0, "engine": 0}


def landing_folder(spark, *documents):
    path = scratch_path(spark, "json")
    frame = spark.createDataFrame([(json.dumps(d, indent=4).replace("\n", " "),) for d in documents], "value string")
    frame.write.option("maxRecordsPerFile", 1).text(path)
    return path


def test_objects_and_lists_are_read_alike(spark):
    path = landing_folder(spark, RECORD, [RECORD, dict(RECORD, asset="B")])
    assert sorted(r["asset"] for r in landing.read_records(spark, path).collect()) == ["A", "A", "B"]


def test_a_folder_is_loaded_with_new_names_and_types(spark):
    name = new_table(spark, "staged")
    path = landing_folder(spark, RECORD, [RECORD])
    landing.load_folder(spark, path, name)
    landing.load_folder(spark, path, name)
    assert spark.table(name).count() == 4
    assert dict(spark.table(name).dtypes) == {
        "scraped_timestamp": "timestamp_ntz", "asset": "string", "price": "double", "source_id": "int", "engine_id": "int"
    }


def test_statements_run_in_order_and_take_values(spark):
    spark.range(10).createOrReplaceTempView("ten")
    result = run_statements(
        spark,
        [
            ("CREATE OR REPLACE TEMP VIEW upper_ten AS SELECT id FROM ten WHERE id >= 5", {}),
            ("SELECT sum(id) AS s FROM IDENTIFIER(:t) WHERE id < :top", {"t": "upper_ten", "top": 9}),
        ],
    )
    assert result.first()["s"] == 5 + 6 + 7 + 8
    with pytest.raises(ValueError):
        run_statements(spark, [])


def test_values_are_bound_not_pasted(spark):
    spark.createDataFrame([("x' OR '1'='1",), ("y",)], "v string").createOrReplaceTempView("quoted")
    rows = guarded_select(spark, "SELECT v FROM quoted WHERE v = :v", limit=10, args={"v": "x' OR '1'='1"}).collect()
    assert len(rows) == 1


def test_a_limit_must_be_given(spark, tmp_path):
    with pytest.raises(TypeError):
        guarded_select(spark, "SELECT 1")
    with pytest.raises(ValueError):
        guarded_select(spark, "SELECT 1", limit=0)
    file = tmp_path / "q.sql"
    file.write_text("SELECT id FROM range(7)")
    assert guarded_select(spark, path=str(file), limit=7).count() == 7
    with pytest.raises(ValueError, match="more than 6"):
        guarded_select(spark, path=str(file), limit=6)
    with pytest.raises(ValueError):
        statement_text("SELECT 1", str(file))


@pytest.fixture
def orders(spark):
    url, name = jdbc_url(spark), new_table(spark, "o").split(".")[1]
    relational.execute(spark, url, [f"CREATE TABLE {name} (id bigint primary key, asset varchar(10), price double precision)"])
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(1, 21)], "id long, asset string, price double")
    relational.append_rows(rows.select("price", "asset", "id"), url, name)
    return url, name


def contents(spark, url, name):
    return sorted(tuple(r) for r in relational.read_table(spark, url, name, "id", 3).collect())


def test_relational_rows_go_by_name_and_are_read_in_ranges(spark, orders):
    url, name = orders
    frame = relational.read_table(spark, url, name, "id", 3)
    assert frame.rdd.getNumPartitions() == 3
    assert contents(spark, url, name) == [(i, "a" if i % 2 else "b", float(i)) for i in range(1, 21)]


def test_relational_delete_insert_is_one_transaction(spark, orders):
    url, name = orders
    clash = spark.createDataFrame([(2, "a", 0.0)], "id long, asset string, price double")
    with pytest.raises(Exception, match="duplicate key"):
        relational.delete_insert_rows(clash, url, name, ["asset = 'a'"])
    assert len(contents(spark, url, name)) == 20
    relational.delete_insert_rows(clash.withColumn("id", F.lit(101)), url, name, ["asset = 'a'", "price > 1"])
    assert [r[0] for r in contents(spark, url, name)] == [1, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 101]


def test_relational_replace_and_last_result(spark, orders):
    url, name = orders
    relational.replace_all_rows(spark.createDataFrame([(7, "z", 7.0)], "id long, asset string, price double"), url, name)
    assert contents(spark, url, name) == [(7, "z", 7.0)]
    last = relational.select_last(spark, url, [f"UPDATE {name} SET price = 8", f"SELECT price FROM {name}"])
    assert last.first()[0] == 8.0
    with pytest.raises(ValueError):
        relational.delete_rows(spark, url, name, [])
