from __future__ import annotations

import pytest
from compare import connect, differences

import tickloom.llm.queries  # noqa: F401
from tickloom.registry.book import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [name for name in QUERIES if name.startswith("op") and name in ORACLES])
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []
