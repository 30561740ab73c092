"""Rows and values that must not get lost, and gaps that must not be papered over."""

from __future__ import annotations

import math

import pytest

from fieldspark.functions.expr import lookup
from fieldspark.operators import rollup, series, stats, zonal
from fieldspark.plans import jobs
from pyspark.sql import functions as F


def obs(spark, values):
    return spark.createDataFrame([(1, i, float(10 * i), v) for i, v in enumerate(values)],
                                 "plot_id long, pass int, doy double, v double")


@pytest.mark.parametrize("gap", [None, math.nan])
def test_a_gap_leaves_no_integral(spark, gap):
    assert series.trapezoid(obs(spark, [1.0, 1.0, gap, 1.0]), mean=True).first().integral is None
    assert series.trapezoid(obs(spark, [1.0, 1.0, 1.0, 1.0]), mean=True).first().integral == 1.0
    frame = obs(spark, [1.0, 1.0, gap, 1.0]).withColumnRenamed("v", "departure")
    r = series.season_close(frame, lookup(F.lit("a"), {"a": 40.0}, "end")).first()
    assert r.season_integral is None and r.extrapolated_fraction is None and r.calendar_end == 40.0


def test_morans_i_seeks_neighbours_among_known_points(spark):
    rows = [(i, float(i % 7), float(i // 7), None if i % 5 == 0 else float(i % 7 + i // 7)) for i in range(49)]
    frame = spark.createDataFrame(rows, "plot_id long, x double, y double, v double")
    known = [r for r in rows if r[3] is not None]
    mean = sum(r[3] for r in known) / len(known)
    num = 0.0
    for r in known:
        near = sorted((math.dist(r[1:3], s[1:3]), s[0], s[3]) for s in known if s[0] != r[0])[:8]
        w = [math.exp(-(d / 1500.0) ** 2) for d, *_ in near]
        num += (r[3] - mean) * sum(k * (v - mean) for k, (_, _, v) in zip(w, near)) / sum(w)
    got = stats.morans_of(frame).first()
    assert got.n == len(known)
    assert got.morans_i == pytest.approx(num / sum((r[3] - mean) ** 2 for r in known))


def test_nan_is_no_value_in_a_rank_correlation(spark):
    rows = [(float(i), float(i * i)) for i in range(20)] + [(math.nan, 3.0), (4.0, None)]
    r = stats.spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert r.n == 20 and r.rho == pytest.approx(1.0) and not math.isnan(r.pearson)


def test_a_zone_without_cells_has_every_pass(spark):
    cells = spark.createDataFrame([(1, 10, 2.0), (1, 20, 4.0)], "plot_id long, pass long, value double")
    core = spark.createDataFrame([(1, 1), (2, 1)], "plot_id long, core_cells long")
    got = {(r.plot_id, r["pass"]): (r.n, r.coverage) for r in zonal.zonal_stats(cells, core).collect()}
    assert got == {(1, 10): (1, 1.0), (1, 20): (1, 1.0), (2, 10): (0, 0.0), (2, 20): (0, 0.0)}


def test_features_keep_a_plot_without_cells(spark):
    doys = {i: 10.0 * i for i in range(5)}
    cells = spark.createDataFrame([(p, i, 1.0 + p + i) for p in range(12) for i in doys],
                                  "plot_id long, pass int, value double")
    plots = spark.createDataFrame([(p, float(p), 0.0, 1) for p in range(13)],
                                  "plot_id long, x double, y double, core_cells long")
    none = spark.createDataFrame([], "pass int, offset double")
    got = jobs.job_features(cells, plots, doys, none).where("plot_id = 12").collect()
    assert len(got) == 5 and all(r.v is not None and r.data_quality == "imputed" for r in got)


def test_a_required_window_that_no_item_mentions_fails(spark):
    items = spark.createDataFrame([("a", "2025-01-01", 5.0)], "window string, d string, cloud double").withColumn("d", F.to_date("d"))
    valid = items.select("window", "d", F.lit(1.0).alias("valid_share"))
    assert rollup.pick_scene(items, valid, ["a"]).count() == 1
    with pytest.raises(Exception, match="no usable date"):
        rollup.pick_scene(items, valid, ["a", "b"]).collect()
