"""Every registered query builds, and agrees with its SQL on the smallest data (skipped where the data is not there)."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
BUILDERS, SQL = entry.queries(), entry.oracle_sql()
# the training-data queries have tests of their own, with and without SQL
NAMES = sorted(name for name in BUILDERS if not re.match(r"op\d+_|pipeline$", name))


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    ok, message, _ = compare(spark, connection, FOLDER, name, BUILDERS[name], SQL.get(name))
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "digest"]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(BUILDERS)
