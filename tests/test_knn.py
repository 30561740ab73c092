"""Nearest neighbours against brute force on clustered, repeated and sparse points."""

from __future__ import annotations

import random

import pytest

from fieldspark.operators import knn


def points(n=600):
    rng = random.Random(3)
    out = []
    for i in range(n):
        if i % 3 == 0:
            x, y = 50.0, 50.0                                   # one location holds a third
        elif i % 3 == 1:
            x, y = 50 + rng.gauss(0, 1e-3), 50 + rng.gauss(0, 1e-3)   # a dense town beside it
        else:
            x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)   # sparse country
        out.append((i, x, y))
    return out


def brute(queries, donors, k, exclude):
    out = {}
    for q, x, y in queries:
        d = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, i) for i, a, b in donors if not (exclude and i == q))
        out[q] = [i for _, i in d[:k]]
    return out


def run(spark, queries, donors, k, exclude, **kw):
    q = spark.createDataFrame(queries, "query_id long, x double, y double")
    d = spark.createDataFrame(donors, "donor_id long, x double, y double")
    got = {}
    for r in knn.knn_join(q, d, k, exclude_self=exclude, **kw).orderBy("query_id", "nn").collect():
        got.setdefault(r.query_id, []).append(r.donor_id)
    return got


def test_self_join_equals_brute_force(spark):
    p = points()
    assert run(spark, p, p, 8, True) == brute(p, p, 8, True)


def test_one_far_outlier_leaves_the_cells_fine(spark):
    p = [*points(), (600, 1e9, 1e9)]
    assert run(spark, p, p, 8, True) == brute(p, p, 8, True)
    d = spark.createDataFrame(p, "plot_id long, x double, y double")
    frame = d.selectExpr("min(x) AS _x0", "min(y) AS _y0", "max(x) - min(x) AS _extent")
    assert max(knn.chosen_levels(knn.finest(d, frame), 8)) > 20


@pytest.mark.parametrize("n", [1, 5, 8, 9])
def test_fewer_donors_than_wanted_are_all_neighbours(spark, n):
    p = points()
    donors, queries = p[:n], p[100:120]
    assert run(spark, queries, donors, 8, False) == brute(queries, donors, 8, False)
    assert run(spark, queries, donors, 8, True) == brute(queries, donors, 8, True)
    if n > 1:
        assert run(spark, donors, donors, 8, True) == brute(donors, donors, 8, True)


def test_other_donors_equal_brute_force(spark):
    p = points()
    donors, queries = p[:400], p[400:]
    assert run(spark, queries, donors, 5, False) == brute(queries, donors, 5, False)


def test_queries_far_outside_the_donors(spark):
    donors = [(i, float(i % 5), float(i // 5)) for i in range(25)]
    queries = [(100, -900.0, 400.0), (101, 2.0, 2.0)]
    assert run(spark, queries, donors, 3, False) == brute(queries, donors, 3, False)


def test_too_few_donors_fail(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0)], "donor_id long, x double, y double")
    with pytest.raises(ValueError):
        knn.donor_gate(d, 8)
