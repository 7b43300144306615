"""Every registered query with a reference SQL gives the same rows on both engines."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["userId", "actions", "evil_actions", "evil_ratio"]
    assert out.count() > 0


def test_sql_has_queries():
    assert set(oracle_sql()) <= set(queries())
