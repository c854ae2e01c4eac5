from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tickloom.operators.segments import SEGMENT_ROWS  # noqa: E402
from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="run-tests-", dir="/tmp")
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=f"{folder}/shared",
        spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_buckets(spark):
    """Cuts keys of more than 20 rows, so that rows cross bucket borders."""
    spark.conf.set(SEGMENT_ROWS, "20")
    yield
    spark.conf.unset(SEGMENT_ROWS)
