"""Rank correlation by cells: rows move once per column, ties and hot values keep exact ranks."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import ordered, stats
from fieldspark.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def ranks(values):
    where = defaultdict(list)
    for place, v in enumerate(sorted(values), 1):
        where[v].append(place)
    return [sum(where[v]) / len(where[v]) for v in values]


def corr(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    vx, vy = sum((i - mx) ** 2 for i in x), sum((j - my) ** 2 for j in y)
    return sum((i - mx) * (j - my) for i, j in zip(x, y)) / math.sqrt(vx * vy) if vx and vy else None


def test_rows_meet_no_table_of_ranks(spark):
    for key in ("same_vs_cross", "spearman", "diff_regression"):
        df = QUERIES[key](spark, SMALL)
        assert not re.search(r"Join.*_r__[ab]#", plan_of(df)), key
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count(
            "Exchange hashpartitioning(_part") == 2, key


@pytest.mark.parametrize("cells, cell_rows", [(1024, 1), (16, 7)])
def test_ranks_are_exact_at_any_size_of_cell(spark, monkeypatch, cells, cell_rows):
    monkeypatch.setattr(ordered, "CELLS", cells)
    monkeypatch.setattr(ordered, "CELL_ROWS", cell_rows)
    r = random.Random(5)
    rows = []
    for g, n in (("p", 3000), ("q", 400), (None, 250), ("few", 9), ("same", 40)):
        for _ in range(n):
            a = r.choice([r.gauss(0, 1), 0.0, -0.0, 7.0, math.inf]) if g == "p" else r.gauss(0, 3) if g != "same" else 4.0
            b = float(r.randrange(5)) if g == "q" else r.random()
            rows.append((g, a, r.choice([b, b, b, 0.5, None, math.nan]), r.randrange(4)))
    df = spark.createDataFrame(rows, "g string, a double, b double, k int")
    for weight in (None, F.col("k")):
        got = {x.g: x for x in stats.spearman(df, "a", "b", ["g"], weight=weight).collect()}
        for g in ("p", "q", None, "few", "same"):
            own = [(a, b) for h, a, b, k in rows if h == g and b is not None and not math.isnan(b)
                   for _ in range(1 if weight is None else k)]
            rho = corr(ranks([a for a, _ in own]), ranks([b for _, b in own])) if len(own) >= stats.MIN_PAIRS else None
            assert got[g].n == len(own)
            assert (got[g].rho is None) if rho is None else got[g].rho == pytest.approx(rho, abs=1e-12), g


def test_a_hot_value_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CELL_ROWS", 10)
    df = spark.range(20_000).selectExpr("id", "if(id % 10 < 9, 3D, cast(id AS double)) AS v", "1L AS w")
    edges = ordered.materialise(df.groupBy().agg(ordered.cell_edges("v").alias("_edges")))
    starts = ordered.cell_starts(df, [], "v", "w", edges)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ordered.centred_ranks(df, [], "v", "w", edges, starts, "id", "r")
        tasks = out.where("v = 3").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 4 and max(t["count"] for t in tasks) < 9_000
        values = [3.0 if i % 10 < 9 else float(i) for i in range(20_000)]
        assert {x.id: x.r for x in out.collect()} == {i: x - 10_000.5 for i, x in enumerate(ranks(values))}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_no_rows(spark):
    d = spark.createDataFrame([], "g string, a double, b double")
    assert stats.spearman(d, "a", "b", ["g"]).collect() == []
    row = stats.spearman(d, "a", "b").collect()
    assert len(row) == 1 and row[0].rho is None and row[0].pearson is None
