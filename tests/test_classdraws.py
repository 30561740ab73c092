"""Totals over draws without a row per plot and draw, against rows that are written out."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import rand
from fieldspark.operators import resample
from fieldspark.operators.joins import with_draws
from fieldspark.operators.rollup import centred_factor


def plots(spark):
    # A class of one plot, one of equal values without noise to speak of, nulls, and many ties.
    rows = [(i, ("a", "b", "c", None)[i % 4] if i else "one", None if i % 11 == 5 else 2.0 if i % 4 == 1 else float(i % 13),
             1e30 if i % 4 == 1 else float(i % 6), 1.5, None if i == 7 else 1.0 + i % 3) for i in range(400)]
    return spark.createDataFrame(rows, "plot_id long, cls string, x double, cells double, reference double, weight double").repartition(3)


def test_noise_draws_equal_rows_by_draws(spark):
    p = plots(spark)
    sd = resample.SPECKLE_DB / F.sqrt(F.greatest(F.col("cells"), F.lit(1.0)))
    d = with_draws(p, 40).withColumn("x", F.col("x") + sd * rand.normal(F.col("plot_id"), F.col("draw"), 15))
    f = centred_factor(d, "x", ["draw", "cls"], 0.3).groupBy("draw").agg(F.sum(F.col("reference") * F.col("factor") * F.col("weight")).alias("t"))
    want = {r.draw: r.t for r in f.collect()}
    got = {r.draw: r.total for r in resample.noise_draws(p, 40).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_no_row_per_plot_and_draw(spark):
    p = plots(spark).withColumn("axis", F.round("x"))
    sigma = spark.createDataFrame([(0.3,)], "sigma double")
    for out in (resample.noise_draws(p, 40),
                resample.prior_draws(p.where("x is not null"), "axis", (0.2, 0.3, 0.5), ("u", "v", "w"), {"u": 1.0, "v": 2.0, "w": 3.0}, sigma, 40)):
        assert "Generate explode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_noise_of_no_plots(spark):
    assert resample.noise_draws(plots(spark).where("false"), 4).collect() == []


def test_ties_take_no_row_per_draw(spark):
    rows = [(i, float(i % 5), 1.0 + i % 3, float(i % 7)) for i in range(300)]
    p = spark.createDataFrame(rows, "plot_id long, axis double, weight double, x double").repartition(3)
    prior, labels = (0.22, 0.05, 0.73), ("u", "v", "w")
    out = resample.tie_permutation(p, "axis", "weight", prior, labels, 30)
    whole, want = sum(r[2] for r in rows), {}
    with_h = {(r.plot_id, r.draw): r.h for r in with_draws(p, 30).select(
        "plot_id", "draw", rand.mix52(F.col("plot_id"), F.col("draw"), 14).alias("h")).collect()}
    for d in range(30):
        upto = 0.0
        for r in sorted(rows, key=lambda r: (r[1], with_h[r[0], d], r[0])):
            upto += r[2]
            k = labels[(upto / whole > 0.22) + (upto / whole > 0.22 + 0.05)]
            want[d, k] = want.get((d, k), 0.0) + r[2]
    assert {(r.draw, r.bucket): r.weight for r in out.collect()} == want
    assert "repartitionbyexpression [draw" not in out._jdf.queryExecution().logical().toString().lower()
    total = resample.tie_totals(p, "axis", prior, labels, {"u": 1.0, "v": 2.0, "w": 3.0}, 30)
    assert "Generate explode" not in total._jdf.queryExecution().optimizedPlan().toString() and total.count() == 30
