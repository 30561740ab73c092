"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check import database, differences

from fieldspark.plans import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
# At this scale the SQL itself gives no rows for these.
EMPTY = {"grid_window_filter", "best_by_group"}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in EMPTY])
def test_query(key, spark, con):
    assert differences(key, spark, con, FOLDER) == []


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
