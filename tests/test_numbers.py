import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import market, numbers


def _rounded(spark, values, places):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = numbers.with_nearest(frame, {"r": F.col("v")}, places).collect()
    return [row["r"] for row in sorted(rows, key=lambda row: row["i"])]


def test_nearest_equals_round_on_ties_and_near_ties(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.125, -2.675, 0.0, 1e-9, 0.005, 0.015, 1234567.885, 4503599627370.495]
    values += [n / 8 for n in range(-400, 400)] + [n / 200 for n in range(-2000, 2000)]
    assert _rounded(spark, values, 2) == [round(v, 2) for v in values]


def test_nearest_equals_round_on_random_values(spark):
    source = random.Random(7)
    values = [source.uniform(-1, 1) * 10 ** source.randint(-4, 9) for _ in range(50_000)]
    values += [source.randint(0, 10**9) / 1000 for _ in range(50_000)]
    for places in (0, 2, 3, 6):
        assert _rounded(spark, values, places) == [round(v, places) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9), min_size=1, max_size=200))
def test_nearest_equals_round(spark, values):
    assert _rounded(spark, values, 2) == [round(v, 2) for v in values]


def test_nearest_equals_round_where_the_scaled_value_cannot_hold_halves(spark):
    source = random.Random(11)
    for places in (0, 1, 2, 3, 6, 7):
        top = [source.choice((-1, 1)) * source.uniform(2.0**50, 2.0**54) / 10**places for _ in range(4000)]
        ties = [source.choice((-1, 1)) * (source.randint(2**51, 2**52) // 8 + source.randint(0, 7) / 8) / 2**k for k in range(12) for _ in range(200)]
        assert _rounded(spark, top + ties, places) == [round(v, places) for v in top + ties]


def test_nearest_keeps_null_and_huge_values(spark):
    assert _rounded(spark, [None, 1e300, float("inf")], 2) == [None, 1e300, float("inf")]


def test_floor_to_goes_down(spark):
    frame = spark.createDataFrame([(1.2345,), (-1.2341,), (2.0,)], "v double")
    assert [r[0] for r in frame.select(numbers.floor_to(F.col("v"), 3)).collect()] == [1.234, -1.235, 2.0]


def test_step_lookup_takes_the_largest_trigger_reached(spark):
    frame = spark.createDataFrame([(2.99,), (3.0,), (4.9,), (5.0,), (1000.0,), (None,)], "v double")
    rows = frame.select(market.step_lookup("v", market.TRAILING_LEVELS)).collect()
    assert [r[0] for r in rows] == [None, 1.5, 1.5, 3.0, 85.0, None]


def test_step_lookup_does_not_depend_on_the_order_of_levels(spark):
    frame = spark.range(100).select(F.col("id").cast("double").alias("v"))
    levels = list(market.TRAILING_LEVELS)
    random.Random(1).shuffle(levels)
    pair = frame.select(market.step_lookup("v", levels), market.step_lookup("v", market.TRAILING_LEVELS))
    assert all(a == b for a, b in pair.collect())


def test_ladder_ends_before_its_limit():
    rungs = market.ladder()
    assert len(rungs) == 30 and rungs[0] == 0.01 and rungs[-1] <= 15 < rungs[-1] + 0.5
