"""Every registered query: equal to its SQL on the smallest tables, or non-empty."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    if name in oracle_sql():
        assert compare(spark, con, FOLDER, queries()[name], oracle_sql()[name]) is None
    else:
        assert queries()[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    got = entry(spark)
    assert got.count() == 2 and {"fold", "auc", "auc_pr", "log_loss", "f1"} <= set(got.columns)
