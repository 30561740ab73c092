"""Plans that keep what grows with the input out of the driver and out of single tasks."""

from __future__ import annotations

import re

from fieldspark.operators import joins, knn
from fieldspark.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_region_cells_are_not_broadcast(spark):
    for key in ("largest_overlap", "containment_totals"):
        assert not re.search(r"BroadcastHashJoin \[r#\S+, c#", plan_of(QUERIES[key](spark, SMALL))), key


def test_fine_cells_are_not_joined(spark):
    rows = [(1, r, c, None if (r * c) % 5 == 3 else float(r * 7 + c * c)) for r in range(6) for c in range(5) if (r, c) != (2, 2)]
    coarse = spark.createDataFrame(rows, "pass int, r long, c long, value double")
    fine = coarse.selectExpr("pass", "r", "c", "explode(sequence(0, 15)) AS i").selectExpr("pass", "r * 4 + i div 4 AS r", "c * 4 + i % 4 AS c")
    want = joins.resample_nearest(coarse, fine, 4, ["pass"]).withColumnRenamed("value", "nearest").join(
        joins.resample_bilinear(coarse, fine, 4, ["pass"]).withColumnRenamed("value", "bilinear"), ["pass", "r", "c"])
    got = joins.refine(coarse, 4, ["pass"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    plan = plan_of(QUERIES["resample_grid"](spark, SMALL))
    assert "Join" not in plan


def test_pairs_of_neighbours_are_dealt_by_locations(spark, monkeypatch):
    monkeypatch.setattr(knn, "SPOTS", 50)
    p = spark.range(400).selectExpr("id", "cast(id % 20 AS double) AS x", "cast(id div 20 AS double) AS y")
    out = knn.knn_join(p.withColumnRenamed("id", "query_id"), p.withColumnRenamed("id", "donor_id"), 4)
    assert out.count() == 1600 and re.search(r"hashpartitioning\(_l#.*, 8\), REPARTITION_BY_NUM", plan_of(out))
