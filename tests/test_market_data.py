"""Moves, scoring, state, profit and messages on small hand-checked inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.functions import documents, text
from tickloom.operators import keyed, messages, pnl, scoring, shaping
from tickloom.operators import ticks as t
from tickloom.plans import model_weights

T0 = datetime.datetime(2024, 1, 30)


def tick_frame(spark, prices, asset="A"):
    rows = [(i, asset, T0 + datetime.timedelta(seconds=i), T0.date(), p) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "id long, asset string, scraped_timestamp timestamp_ntz, scraped_date date, price double")


def test_the_move_looks_at_the_newer_tick(spark):
    ticks = tick_frame(spark, [1.0, 3.0, 3.0, 2.0])
    for moves in (t.latest_moves(ticks, 10), t.all_moves(ticks)):
        rows = {r["id"]: (r["diff"], r["true_result"]) for r in t.label_moves(moves).collect()}
        assert rows == {0: (2.0, 1), 1: (0.0, None), 2: (-1.0, 0), 3: (None, None)}


def test_latest_moves_know_the_tick_after_the_oldest_kept(spark):
    rows = {r["id"]: r["diff"] for r in t.latest_moves(tick_frame(spark, [1.0, 3.0, 7.0, 2.0]), 2).collect()}
    assert rows == {2: -5.0, 3: None}


def predictions(spark, rows):
    full = [("A", tick, model, value, T0, T0.date()) for tick, model, value in rows]
    return spark.createDataFrame(
        full, "asset string, raw_data_id long, model_type string, prediction double, predicted_timestamp timestamp_ntz, predicted_date date"
    )


def test_weights(spark):
    ticks = tick_frame(spark, [1.0, 2.0, 1.0, 3.0])
    given = predictions(
        spark,
        [(0, "all", 0.9), (1, "all", 0.2), (2, "all", 1.0), (0, "half", 1.0), (1, "half", 1.0), (0, "never", 0.0),
         (1, "odd", 7.0), (2, "odd", 1.0), (2, "gap", None), (3, "all", 1.0), (0, "all", 0.4)],
    )
    result = model_weights.recent_weights(ticks, given, T0.date(), 1, 15)
    rows = {r["model_type"]: r for r in result.collect()}
    assert set(rows) == {"all", "half", "odd"}
    assert (rows["all"]["corrected_prediction"], rows["all"]["total_predicted"]) == (3, 4)
    assert rows["half"]["accuracy"] == 0.5 and rows["odd"]["accuracy"] == 0.5
    assert rows["all"]["weight"] == pytest.approx(0.75 / 1.75)
    assert sum(r["weight"] for r in rows.values()) == pytest.approx(1)
    history = {r["model_type"]: r["weight"] for r in model_weights.history_weights(ticks, given).collect()}
    assert history == {name: row["weight"] for name, row in rows.items()}


def test_a_prediction_outside_0_and_1_is_wrong_without_a_signal(spark):
    actual = t.label_moves(t.all_moves(tick_frame(spark, [1.0, 2.0])))
    row = scoring.judged(actual, predictions(spark, [(0, "odd", 7.0)])).first()
    assert (row["result"], row["signal"], row["prediction"]) == ("wrong", None, 7)


def test_the_look_back_and_asset_filters(spark):
    old = tick_frame(spark, [1.0, 2.0]).withColumn("scraped_date", F.lit(datetime.date(2024, 1, 28)))
    assert model_weights.recent_weights(old, predictions(spark, [(0, "m", 1.0)]), T0.date(), 1, 15).collect() == []
    other = model_weights.recent_weights(tick_frame(spark, [1.0, 2.0]), predictions(spark, [(0, "m", 1.0)]), T0.date(), 1, 15, asset="B")
    assert other.collect() == []


PUTS = "k string, weight double, note string, updated_at timestamp_ntz, seq int"


def test_a_put_replaces_the_whole_item(spark):
    state = spark.createDataFrame([("a", 1.0, "old", T0, 1), ("b", 2.0, "kept", T0, 2)], PUTS)
    batch = spark.createDataFrame([("a", None, None, T0, 3)], PUTS)
    rows = {r["k"]: (r["weight"], r["note"], r["seq"]) for r in keyed.put(state, batch, ["k"], ["updated_at", "seq"]).collect()}
    assert rows == {"a": (None, None, 3), "b": (2.0, "kept", 2)}
    thin = keyed.put(state, batch.drop("note"), ["k"], ["updated_at", "seq"])
    assert thin.filter("k = 'a'").first()["note"] is None


def test_newest_items_with_ties_nulls_and_any_order(spark, monkeypatch):
    """The same winners with few keys, with more than are broadcast, and with an order that only structs can carry."""
    schema = "k string, moment string, v int, at timestamp_ntz, seq int, d date"
    rows = [("a", "x", 1, T0, 1, None), ("a", "y", 2, T0, 2, None), ("a", "z", 3, None, 9, None), (None, "n", 4, None, None, None),
            (None, "m", 5, None, 3, None), ("b", None, 6, T0, None, None), ("b", "t", 7, T0, -5, None), ("c", "tie", 8, T0, 1, None), ("c", "tie", 8, T0, 1, None)]
    puts = spark.createDataFrame(rows, schema)
    want = {"a": 2, None: 5, "b": 7, "c": 8}
    for keys_at_most in (1_000_000, 0):
        monkeypatch.setattr(keyed, "MAX_BROADCAST_KEYS", keys_at_most)
        for order in (["at", "seq"], ["at", "seq", "moment"]):
            found = keyed.latest_per_key(puts, ["k"], order)
            assert found.columns == puts.columns and {r.k: r.v for r in found.collect()} == want
        assert {r.k: r.v for r in keyed.latest_per_key(puts.filter("v < 4"), ["k"], ["seq"]).collect()} == {"a": 3}
        tied = [{r.k: r.v for r in keyed.latest_per_key(puts.orderBy("v", ascending=up), ["k"], ["d"]).collect()} for up in (True, False)]
        assert tied[0] == tied[1] and set(tied[0]) == {"a", None, "b", "c"}
    assert keyed.latest_per_key(puts.limit(0), ["k"], ["at", "seq"]).count() == 0


def test_expiry(spark):
    items = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "k string, days int")
    stamped = keyed.stamped(items, F.lit(T0).cast("timestamp_ntz"), F.col("days"))
    now = int(T0.replace(tzinfo=datetime.UTC).timestamp())
    assert {r["k"]: r["expiration_time"] for r in stamped.collect()} == {"a": now + 86400, "b": None, "c": now}
    assert {r["k"] for r in keyed.live(stamped, F.lit(now)).collect()} == {"a", "b"}
    assert {r["k"] for r in keyed.live(stamped, F.lit(now + 86400)).collect()} == {"b"}


def test_get_and_delete_by_key(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("a",), ("absent",)], "k string")
    assert [r["v"] for r in keyed.get(state, keys, ["k"]).collect()] == [1]
    assert [r["v"] for r in keyed.delete(state, keys, ["k"]).collect()] == [2]


def test_pnl_bounds(spark):
    at = [T0, T0 + datetime.timedelta(hours=1), T0 + datetime.timedelta(hours=1, microseconds=900)]
    income = spark.createDataFrame(
        [(a, "REALIZED_PNL", 1.0) for a in at] + [(T0, "FUNDING_FEE", 100.0)],
        "income_time timestamp_ntz, income_type string, income double",
    )
    assert pnl.total_pnl(income, at[0], at[1]).first()[0] == 3.0
    assert pnl.total_pnl(income, at[1] + datetime.timedelta(seconds=1), at[1] + datetime.timedelta(days=1)).first()[0] == 0.0
    assert pnl.bounds(None, None, now=at[1]) == (T0, at[1])
    with pytest.raises(ValueError):
        pnl.bounds(T0, None)
    with pytest.raises(ValueError):
        pnl.bounds(None, T0)


def test_message_text(spark):
    signals = spark.createDataFrame(
        [("BTC", 1, 2, "gru", "sell"), ("BTC", 1, 1, "lstm", "buy")], "asset string, notice int, ord int, model string, signal string"
    )
    block = "\n        model: {}\n        signal: {}\n        ---------------\n        "
    assert messages.message_bodies(signals).first()["body"] == "asset: BTC" + block.format("lstm", "buy") + block.format("gru", "sell")


def test_exact_decimals_at_any_depth(spark):
    frame = spark.sql(
        "SELECT named_struct('a', 0.1D, 'l', array(0.2D, null), 'm', map('x', named_struct('f', 0.3F, 'i', 7)), 's', 'text',"
        " 'n', cast(null as struct<v: double>)) AS item"
    )
    exact = frame.select(documents.exact_decimals(F.col("item"), frame.schema["item"].dataType).alias("item")).first()["item"]
    assert str(exact["a"]) == "0.100000000000000000" and str(exact["l"][0]) == "0.200000000000000000" and exact["l"][1] is None
    assert str(exact["m"]["x"]["f"]) == "0.300000000000000000" and exact["m"]["x"]["i"] == 7
    assert exact["s"] == "text" and exact["n"] is None


def test_type_names(spark):
    frame = spark.createDataFrame([('{"a":"x","b":1,"c":1.5,"d":null,"e":true,"f":[1],"g":{"h":1}}',)], "doc string")
    names = frame.select(documents.json_type_names(F.col("doc"), list("abcdefgz"))).first()[0]
    assert names == ["str", "int", "float", "NoneType", "bool", "list", "dict", "NoneType"]


def test_paths(spark):
    frame = spark.createDataFrame([("raw/new/x.json",), ("other/raw/new/x.json",)], "p string")
    rows = frame.select(text.base_name(F.col("p")), text.with_prefix(F.col("p"), "raw/new/", "raw/done/")).collect()
    assert [tuple(r) for r in rows] == [("x.json", "raw/done/x.json"), ("x.json", "other/raw/new/x.json")]


def test_shaping_refuses_what_it_cannot_do(spark):
    frame = spark.range(1)
    with pytest.raises(ValueError):
        shaping.strict_cast(frame, {"absent": "int"})
    with pytest.raises(ValueError):
        shaping.all_of([])
    assert shaping.rename(frame, {"absent": "x"}).columns == ["id"]


def test_ordinal_orders_by_time_then_number(spark):
    from tickloom.functions.moments import ordinal

    times = [datetime.datetime(1969, 1, 1), T0, T0 + datetime.timedelta(microseconds=1), datetime.datetime(9999, 12, 31)]
    pairs = [(t, n) for t in times for n in (-(2**63), -1, 0, 2**63 - 1)]
    frame = spark.createDataFrame(pairs, "t timestamp_ntz, n long")
    rows = [tuple(r) for r in frame.orderBy(ordinal(F.col("t"), F.col("n"))).collect()]
    assert rows == sorted(pairs)


def test_a_float_that_loses_digits_is_an_error(spark):
    from pyspark.errors import PySparkException

    for value in (1.2345e-15, 1e21):
        frame = spark.createDataFrame([(value,)], "v double")
        with pytest.raises(PySparkException):
            frame.select(documents.exact_decimals(F.col("v"), frame.schema["v"].dataType)).collect()


def test_type_names_of_malformed_records_and_big_integers(spark):
    frame = spark.createDataFrame([('{"a": 123456789012345678901, "b": 1.5}',), ('{"a": ',)], "doc string")
    names = [r[0] for r in frame.select(documents.json_type_names(F.col("doc"), ["a", "b"])).collect()]
    assert names == [["int", "float"], ["NoneType", "NoneType"]]
