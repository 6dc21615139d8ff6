"""Every named query against its check query, over the smallest given tables."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert differences(df, con, oracle_sql()[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry(spark).count() == 1500
