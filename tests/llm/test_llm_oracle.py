"""Queries of this package against their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check import database, rows_of

from fieldspark.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ORACLE)
def test_query(key, spark):
    df = QUERIES[key](spark, FOLDER)
    cur = database(FOLDER).execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, cur.fetchall())
    assert want and rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
