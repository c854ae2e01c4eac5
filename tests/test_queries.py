"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query_equals_its_sql(spark, database, name):
    assert differences(entry.queries()[name](spark, SMALL), database, entry.oracle_sql()[name]) == []


def test_entry_gives_weights_that_sum_to_one(spark):
    rows = entry.entry(spark).collect()
    sums = {}
    for row in rows:
        sums[row["asset"]] = sums.get(row["asset"], 0) + row["weight"]
    assert rows and all(abs(total - 1) < 1e-3 for total in sums.values())


def test_ordered_queries_across_bucket_borders(spark, database, small_buckets):
    for name in ("w1_price_move_history", "w1_price_move_with_ties", "w4_stop_ratchet", "a4_model_weights_history"):
        assert differences(entry.queries()[name](spark, SMALL), database, entry.oracle_sql()[name]) == []
