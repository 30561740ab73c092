"""Single operators on hand-built frames."""

from __future__ import annotations

import math
import random
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import expr, pvalues, rand
from fieldspark.operators import (cluster, gates, geometry, joins, resample, rollup, series, stats, text, zonal)
from fieldspark.plans import jobs
from fieldspark.sources import io

REFERENCE = {"Bajra": 1.362, "Maize": 2.035, "Groundnut": 2.734}
CALENDAR = {"Bajra": 270.0, "Maize": 288.0, "Groundnut": 305.0, "Rice": 310.0, "Cotton": 380.0}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def season(spark, *plots):
    """(plot_id, cls, departures on days 226, 286, 316)."""
    rows = [(i, c, p, d, v) for i, c, dep in plots for p, d, v in zip((3, 4, 6), (226.0, 286.0, 316.0), dep)]
    return spark.createDataFrame(rows, "plot_id long, cls string, pass int, doy double, departure double")


# -- expressions ------------------------------------------------------------------------------
def test_decibel_of_nothing_is_null(spark):
    d = spark.createDataFrame([(10.0,), (0.0,), (-1.0,)], "x double")
    assert [r[0] for r in d.select(expr.to_db(F.col("x"))).collect()] == [10.0, None, None]


def test_calibration_ladder_and_floor(spark):
    d = spark.createDataFrame([(3.0, 4.0, 30.0, 0.1), (0.0, 0.0, 30.0, 0.1), (0.1, 0.0, 30.0, 0.5)], "i double, q double, a double, n double")
    got = [r[0] for r in d.select(expr.calibrated_gamma(F.col("i"), F.col("q"), F.lit(2.0), F.col("a"), F.col("n"))).collect()]
    s, c = math.sin(math.radians(30)), math.cos(math.radians(30))
    assert got == pytest.approx([(25 * 4 * s - 0.1) / c, 0.0, 0.005 / c])


def test_incidence_is_anchored_at_the_centre(spark):
    d = spark.createDataFrame([(0.0,), (500.0,), (1000.0,)], "c double").select(expr.incidence_deg(
        F.col("c"), F.lit(1000.0), F.lit(6e5), F.lit(0.5), F.lit(5.25e5), F.lit(6.371e6), F.lit(28.7)).alias("a"))
    a = [r.a for r in d.collect()]
    assert a[1] == pytest.approx(28.7) and a[0] < a[1] < a[2]


def test_polynomial_is_low_order_first(spark):
    assert one(spark.range(1).select(expr.poly_eval(F.lit(2.0), F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0)))))[0] == 27.0


def test_folded_angle(spark):
    d = spark.createDataFrame([(318.4,), (48.4,), (138.4,), (3.4,)], "a double")
    assert [r[0] for r in d.select(expr.folded_angle(F.col("a"), 318.4)).collect()] == pytest.approx([0, 90, 0, 45])


def test_unknown_category_fails(spark):
    d = spark.createDataFrame([("Bajra",), ("Barley",)], "c string")
    with pytest.raises(Exception, match="no reference for Barley"):
        d.select(expr.lookup(F.col("c"), REFERENCE, "reference")).collect()


def test_clip_keeps_null(spark):
    d = spark.createDataFrame([(None,), (-2.0,), (3.0,)], "x double")
    assert [r[0] for r in d.select(expr.clip_pos(F.col("x"))).collect()] == [None, 0.0, 3.0]


# -- p values (known values of the distributions) ---------------------------------------------
@pytest.mark.parametrize("make, want", [
    (lambda: pvalues.normal_sf(F.lit(1.959963984540054)), 0.025),
    (lambda: pvalues.normal_sf(F.lit(-1.0)), 0.8413447460685429),
    (lambda: pvalues.normal_sf(F.lit(6.0)), 9.865876450376946e-10),
    (lambda: pvalues.student_t_two_sided(F.lit(2.2281388519649385), F.lit(10.0)), 0.05),
    (lambda: pvalues.chi2_sf(F.lit(5.991464547107979), F.lit(2)), 0.05),
    (lambda: pvalues.chi2_sf(F.lit(3.841458820694124), F.lit(1)), 0.05),
    (lambda: pvalues.chi2_sf(F.lit(11.070497693516351), F.lit(5)), 0.05),
    (lambda: pvalues.f_sf(F.lit(4.10282101716), F.lit(2.0), F.lit(10.0)), 0.05)])
def test_tail_probabilities(spark, make, want):
    assert one(spark.range(1).select(make().alias("p"))).p == pytest.approx(want, rel=1e-7)


def test_hash_numbers_do_not_depend_on_partitions(spark):
    def draw(n):
        d = spark.range(0, 20000, numPartitions=n)
        return one(d.agg(F.avg(rand.uniform(F.col("id"), F.lit(1), 9)).alias("u"), F.var_pop(rand.normal(F.col("id"), F.lit(1), 9)).alias("v"),
                         F.avg(rand.poisson1(rand.uniform(F.col("id"), F.lit(1), 9))).alias("p"), F.sum(rand.mix32(F.col("id"), F.lit(1), 9)).alias("s")))
    a, b = draw(2), draw(9)
    assert a.s == b.s
    assert a.u == pytest.approx(0.5, abs=0.01) and a.v == pytest.approx(1, abs=0.03) and a.p == pytest.approx(1, abs=0.03)


# -- season -----------------------------------------------------------------------------------
def test_departure_removes_the_drift(spark):
    obs = spark.createDataFrame([(1, p, float(p), v) for p, v in ((1, -20.0), (2, -19.0), (3, -15.0))], "plot_id long, pass int, doy double, v double")
    drift = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0)], "pass int, drift_db double")
    got = {r["pass"]: r.departure for r in series.departure(obs, drift, (1, 2)).collect()}
    assert got == pytest.approx({1: 0.0, 2: 0.0, 3: 3.0})


def test_peak_takes_the_first_day_on_ties_and_needs_an_episode(spark):
    got = {r.plot_id: r for r in series.peak(season(spark, (1, "a", (2.0, 2.0, 1.0)), (2, "a", (0.2, -1.0, 0.1)))).collect()}
    assert (got[1].peak_v, got[1].peak_doy, got[1].end_v) == (2.0, 226.0, 1.0)
    assert (got[2].has_canopy, got[2].peak_doy) == (False, None)


def test_cleared_fraction(spark):
    got = {r.plot_id: r for r in series.cleared(season(
        spark, (1, "a", (2.0, 1.0, 0.5)), (2, "a", (0.1, 0.2, 0.1)), (3, "a", (1.0, 1.0, -4.0)))).collect()}
    assert got[1].cleared_fraction == pytest.approx(0.75) and got[1].late_slope == pytest.approx(-0.5 / 30)
    assert got[2].cleared_fraction is None
    assert got[3].cleared_fraction == 1.0


def test_projection_only_past_the_stack(spark):
    d = season(spark, (1, "Bajra", (1.0, 1.0, 1.0)), (2, "Cotton", (1.0, 1.0, 1.0)), (3, "Cotton", (-1.0, -1.0, -1.0)))
    got = {r.plot_id: r for r in series.season_close(d, expr.lookup(F.col("cls"), CALENDAR, "end"), ["cls"]).collect()}
    assert (got[1].projected, got[1].extrapolated_fraction, got[1].season_integral) == (0.0, 0.0, 1.0)
    assert got[2].projected == 64.0 and got[2].extrapolated_fraction == pytest.approx(64 / 154)
    assert got[2].season_integral == pytest.approx(1.0)
    assert got[3].projected == 0.0 and got[3].season_integral == pytest.approx(-90 / 154)


def test_gap_fill_holds_ends_flat_and_needs_enough_values(spark):
    def obs(i, values):
        return [(i, p, float(d), v) for p, (d, v) in enumerate(zip((0, 10, 30, 40, 50), values))]
    d = spark.createDataFrame(obs(1, (None, 1.0, None, 4.0, 6.0)) + obs(2, (None, 1.0, None, None, None)), "plot_id long, pass int, doy double, v double")
    got = {(r.plot_id, r["pass"]): r.filled for r in series.gap_fill(d, 3).collect()}
    assert [got[1, p] for p in range(5)] == pytest.approx([1.0, 1.0, 3.0, 4.0, 6.0])
    assert got[2, 0] is None


def test_line_anomaly(spark):
    d = spark.createDataFrame([(1, 4, 286.0, 2.0), (1, 5, 302.0, 9.0), (1, 6, 316.0, 5.0)], "plot_id long, pass int, doy double, v double")
    r = one(series.line_anomaly(d, 5, 4, 6))
    assert r.line == pytest.approx(2 + 16 / 30 * 3) and r.anomaly == pytest.approx(9 - r.line)


def test_antecedent_index(spark):
    days = spark.createDataFrame([(date(2025, 6, d), v) for d, v in ((1, 10.0), (9, 5.0), (10, 2.0), (11, 99.0))], "d date, v double")
    r = one(series.antecedent(spark.createDataFrame([(date(2025, 6, 11),)], "d date"), days))
    assert (r.day_value, r.prev3, r.prev7, r.prev14) == (99.0, 7.0, 7.0, 17.0)
    assert r.api == pytest.approx(2 * 0.9 + 5 * 0.81 + 10 * 0.9 ** 10)


def test_season_counts_june_to_november(spark):
    d = spark.createDataFrame([(date(y, m, 1), float(m)) for y in (1, 2, 3) for m in range(1, 13)], "d date, v double")
    r = one(rollup.season_anomaly(d, 3, (1, 2)))
    assert (r.total, r.mean, r.sd) == (51.0, 51.0, 0.0)


def test_five_predictors(spark):
    d = spark.createDataFrame([(1, "Bajra", 2.0, 1.0), (2, "Cotton", 2.0, 1.0), (3, "Cotton", 0.0, 3.0)], "plot_id long, cls string, d3 double, d4 double")
    p = series.predictors(d, expr.lookup(F.col("cls"), CALENDAR, "end"))
    got = {(r.plot_id, r.predictor): r.pred for r in p.collect()}
    assert got[1, "flat_hold"] == 0.0 and got[2, "flat_hold"] == 1.0
    assert got[1, "decay"] == 0.0 and got[2, "decay"] == pytest.approx(0.5) and got[3, "decay"] == 3.0
    assert got[2, "class_mean"] == 2.0 and got[2, "linear"] == pytest.approx(0.5)


# -- rollups ----------------------------------------------------------------------------------
def plots(spark, n=60):
    rows = [(i, ("Bajra", "Maize", "Groundnut")[i % 3], 0.5 + i % 7, float(i % 11), 1.0 + (i % 5) / 10) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "plot_id long, cls string, weight double, x double, value double")


def test_centred_factor_is_one_at_the_median(spark):
    f = rollup.centred_factor(plots(spark, 63), "x", ["cls"], 0.3)
    rows = f.collect()
    for c in REFERENCE:
        v = [r.factor for r in rows if r.cls == c]
        assert np.median(v) == pytest.approx(1.0) and min(v) >= 0.7 and max(v) <= 1.3


def test_zero_width_side_counts_nothing(spark):
    d = spark.createDataFrame([(i, "a", 1.0 if i < 8 else 5.0) for i in range(10)], "plot_id long, cls string, x double")
    assert min(r.factor for r in rollup.centred_factor(d, "x", ["cls"], 0.3).collect()) == 1.0


def test_span_zero_is_the_null_model(spark):
    f = rollup.centred_factor(plots(spark), "x", ["cls"], 0.0)
    assert {r.factor for r in f.collect()} == {1.0}


def test_rounding_comes_before_the_product(spark):
    d = spark.createDataFrame([(1, 1.00004, 2.00006)], "plot_id long, weight double, value double")
    assert one(rollup.round_shipped(d, ["weight", "value"])).production == pytest.approx(2.0001)


def test_rollup_reconciles_and_gate_sees_a_change(spark):
    p = plots(spark).withColumns({"production": F.col("value") * F.col("weight"), "reference": F.lit(1.0), "fraction": F.lit(0.1), "confidence": F.lit("high")})
    r = rollup.weighted_rollup(p)
    assert r.where("cls = 'ALL'").first().reference is None
    gates.require(gates.reconcile_gate(p, r))
    off = r.withColumn("production", F.when(F.col("cls") == "Bajra", F.col("production") + 1e-3).otherwise(F.col("production")))
    with pytest.raises(gates.GateError, match="production_off=1"):
        gates.require(gates.reconcile_gate(p, off))


def test_mode_takes_the_smallest_on_ties(spark):
    d = spark.createDataFrame([("g", 2), ("g", 1), ("g", 2), ("g", 1), ("g", 3)], "g string, c int")
    assert one(rollup.mode_low(d, ["g"], "c")).mode == 1


def test_required_window_without_a_date_fails(spark):
    items = spark.createDataFrame([("a", date(2025, 1, 1), 10.0), ("b", date(2025, 1, 2), 95.0)], "window string, d date, cloud double")
    valid = spark.createDataFrame([("a", date(2025, 1, 1), 0.9), ("b", date(2025, 1, 2), 0.9)], "window string, d date, valid_share double")
    assert one(rollup.pick_scene(items, valid, [])).window == "a"
    with pytest.raises(Exception, match="no usable date for b"):
        rollup.pick_scene(items, valid, ["b"]).collect()


# -- statistics -------------------------------------------------------------------------------
def test_spearman_on_a_monotone_pair_and_too_few_rows(spark):
    d = spark.createDataFrame([("a", float(i), float(i ** 3)) for i in range(12)] + [("b", 1.0, 2.0)], "g string, x double, y double")
    got = {r.g: r for r in stats.spearman(d, "x", "y", ["g"]).collect()}
    assert got["a"].rho == pytest.approx(1.0) and got["b"].rho is None and got["b"].n == 1


def test_mann_whitney_known_case(spark):
    d = spark.createDataFrame([(v, g) for g, vs in ((1, (19, 22, 16, 29, 24)), (0, (20, 11, 17, 12))) for v in vs], "v int, g int")
    r = one(stats.mann_whitney(d, "v", F.col("g") == 1))
    assert r.u == 17.0 and r.p == pytest.approx(0.11134688653314041, rel=1e-6)


def test_kruskal_known_case(spark):
    d = spark.createDataFrame([(v, g) for g, vs in (("a", (1, 3, 5, 7, 9)), ("b", (2, 4, 6, 8, 10))) for v in vs], "v int, g string")
    r = one(stats.kruskal(d, "v", "g"))
    assert r.h == pytest.approx(0.2727272727272734) and r.p == pytest.approx(0.6015081344405895, rel=1e-6)


def test_fires_split_needs_ten_rows(spark):
    d = spark.createDataFrame([(i, 0.0 if i < 12 else 1.0, 1.0, 0.5) for i in range(15)], "plot_id long, model double, base double, truth double")
    assert [r.subset for r in stats.fires_split(d, "model", "base").collect()] == ["fires"]


# -- resampling -------------------------------------------------------------------------------
def test_tie_permutation_changes_nothing_without_ties(spark):
    d = spark.createDataFrame([(i, float(i), 1.0 + i % 3) for i in range(50)], "plot_id long, axis double, weight double")
    s = resample.tie_spread(resample.tie_permutation(d, "axis", "weight", (0.3, 0.3, 0.4), ("x", "y", "z"), 6))
    for r in s.collect():
        assert r.weight_min == r.weight_max and r.draws == 6


def test_tie_permutation_keeps_the_total(spark):
    d = spark.createDataFrame([(i, float(i % 3), 1.0 + i % 4) for i in range(60)], "plot_id long, axis double, weight double")
    t = resample.tie_permutation(d, "axis", "weight", (0.3, 0.3, 0.4), ("x", "y", "z"), 5)
    assert {round(r.w, 9) for r in t.groupBy("draw").agg(F.sum("weight").alias("w")).collect()} == {150.0}


def test_permutation_keeps_the_values(spark):
    d = spark.createDataFrame([(i * 7, float(i)) for i in range(40)], "plot_id long, v double")
    rows = resample.permuted_values(d, 3, 1).collect()
    deals = {k: tuple(r.v for r in sorted((r for r in rows if r.draw == k), key=lambda r: r.plot_id)) for k in range(3)}
    assert all(sorted(v) == [float(i) for i in range(40)] for v in deals.values()) and len(set(deals.values())) == 3


# -- clustering -------------------------------------------------------------------------------
def test_consensus_equals_the_dense_matrix(spark):
    rng = np.random.default_rng(1)
    runs = rng.integers(0, 3, size=(4, 40))
    d = spark.createDataFrame([(r, i, int(runs[r, i])) for r in range(4) for i in range(40)], "run int, plot_id long, cluster int")
    same = [(x[:, None] == x[None, :]).astype(float) for x in runs]
    co = sum(same) / 4
    want = [float((s * co).sum()) for s in same]
    got = {r.run: r.score for r in cluster.consensus(d).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want)
    best = int(np.argmax(want))
    part = {r.plot_id: r for r in cluster.consensus_partition(d).collect()}
    for i in range(40):
        assert part[i].run == best and part[i].stability == pytest.approx(co[i, runs[best] == runs[best][i]].mean())


def test_contingency_makes_no_row_per_plot_and_pair(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(p), r, c) for k in (None, 3, 4) for p in [*range(50), 7] for r, c in enumerate([*rng.integers(0, 3, 5).tolist(), None]) if rng.random() < 0.9]
    d = spark.createDataFrame(rows, "k int, plot_id long, run int, cluster int")
    for by in ([], ["k"]):
        runs, pairs = cluster.contingency(d, "plot_id", by)
        assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
        want = Counter()
        for name in {tuple(r[:1] * len(by)) + r[1:2] for r in rows}:
            mine = [r for r in rows if tuple(r[:1] * len(by)) + r[1:2] == name]
            want.update((*name[:-1], a[2], b[2], a[3], b[3]) for a in mine for b in mine)
        assert {tuple(r)[:-1]: r.n for r in pairs.collect()} == dict(want)
        assert {tuple(r)[:-1]: r.runs for r in runs.collect()} == {(k,) * len(by): 6 for k in (None, 3, 4)}
    assert cluster.contingency(d.limit(0), "plot_id", ["k"])[1].collect() == []


# -- gates ------------------------------------------------------------------------------------
BANDS = {"Bajra": (0.3, 4.0), "Maize": (0.5, 9.0), "Groundnut": (0.3, 5.0)}


def shipped(spark):
    return plots(spark).withColumns({"fraction": F.lit(0.2), "has": F.col("plot_id") % 2 == 0}).withColumn(
        "cleared", F.when(F.col("has"), 0.5))


def gate(df):
    return gates.schema_gate(df, "plot_id", ["plot_id", "cls", "weight", "value"], "cls", list(BANDS), ["fraction", "cleared"],
                             "value", BANDS, rows=60, key_range=(1, 60))


def test_valid_table_passes(spark):
    gates.require(gate(shipped(spark)))
    gates.require(gates.null_pattern_gate(shipped(spark), ["cleared"], "has"))


@pytest.mark.parametrize("column, value, name", [
    ("value", 99.0, "value_outside_band"), ("value", None, "unsound_rows"),
    ("value", float("inf"), "unsound_rows"), ("weight", float("nan"), "unsound_rows"),
    ("fraction", 1.2, "fraction_outside"), ("cls", "Barley", "category_outside"),
    ("plot_id", 7, "duplicate_keys"), ("plot_id", 61, "key_outside")])
def test_one_broken_row_is_found(spark, column, value, name):
    d = shipped(spark).withColumn(column, F.when(F.col("plot_id") == 5, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(gates.GateError, match=name):
        gates.require(gate(d))


def test_missing_row_and_wrong_columns(spark):
    with pytest.raises(gates.GateError, match="row_count_off=1"):
        gates.require(gate(shipped(spark).where("plot_id <> 5")))
    with pytest.raises(gates.GateError, match=r"without \['b'\], with \['c'\]"):
        gates.column_gate(spark.createDataFrame([(1, 2)], "a int, c int"), ["a", "b"])


def test_null_pattern(spark):
    d = shipped(spark).withColumn("cleared", F.when(F.col("plot_id") == 4, None).otherwise(F.col("cleared")))
    with pytest.raises(gates.GateError, match="cleared_pattern=1"):
        gates.require(gates.null_pattern_gate(d, ["cleared"], "has"))


def test_reserved_columns(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None)], "plot_id long, secret double")
    assert one(gates.reserved_gate(d, ["secret"], "backtest", ["validate"])).secret_exposed == 1
    assert one(gates.reserved_gate(d, ["secret"], "validate", ["validate"])).secret_exposed == 0


def test_swap_label_fails_on_an_unmatched_row(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "plot_id long, cls string")
    b = spark.createDataFrame([(1, "z")], "plot_id long, cls string")
    with pytest.raises(Exception, match="no replacement label for 2"):
        joins.swap_label(a, b, "plot_id", "cls").collect()


# -- zonal ------------------------------------------------------------------------------------
def test_zonal_stats_ignore_nodata_and_floor_the_variance(spark):
    c = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0), (1, 1, 0.0), (2, 1, 5.0)], "plot_id long, pass int, value double")
    core = spark.createDataFrame([(1, 4), (2, 1), (3, 9)], "plot_id long, core_cells long")
    got = {r.plot_id: r for r in zonal.zonal_stats(c, core).collect()}
    assert (got[1].n, got[1].mean, got[1].var, got[1].coverage) == (2, 3.0, 1.0, 0.5)
    assert got[2].var is None and got[3].coverage == 0.0


def test_blocks_drop_the_ragged_edge(spark):
    c = spark.createDataFrame([(1, r, k, 1.0) for r in range(5) for k in range(4) if (r, k) != (0, 0)], "pass int, r long, c long, value double")
    got = {(r.br, r.bc): r for r in zonal.block_mean(c, 2).collect()}
    assert set(got) == {(a, b) for a in (0, 1) for b in (0, 1)}
    assert not got[0, 0].full and got[1, 1].full
    assert {(r.br, r.bc) for r in zonal.block_mean(c, 2, shape=(5, 4)).collect()} == set(got)


def test_small_offsets_are_not_applied(spark):
    b = spark.createDataFrame([(p, r, 0, v) for r in range(3) for p, v in ((1, 10.0), (2, 100.0), (3, 10.5))], "pass int, br long, bc long, value double")
    got = {r["pass"]: r for r in zonal.pass_offsets(b, b.select("br", "bc").distinct(), 1).collect()}
    assert got[2].applied == pytest.approx(-10.0) and got[3].applied == 0.0 and got[3].measured != 0.0


def test_mosaic_takes_the_first_source_with_a_value(spark):
    c = spark.createDataFrame([(0, 0, 1, 0.0), (0, 0, 2, 7.0), (0, 0, 3, 9.0)], "r long, c long, src_order int, value double")
    assert one(zonal.mosaic(c)).value == 7.0


# -- joins ------------------------------------------------------------------------------------
def test_nearest_date_prefers_the_earlier(spark):
    t = spark.createDataFrame([(date(2025, 1, 10), date(2025, 1, 9))], "target date, floor date")
    d = spark.createDataFrame([(date(2025, 1, 8),), (date(2025, 1, 12),), (date(2025, 2, 1),)], "d date")
    assert one(joins.nearest_date(t, d)).nearest == date(2025, 1, 8)
    assert one(joins.nearest_date(t, d, after="floor")).nearest == date(2025, 1, 12)


def test_nearest_date_against_brute_force(spark):
    day = lambda k: None if k is None else date(2025, 1, 1) + timedelta(k)
    rng = random.Random(3)
    have = [(s, rng.randrange(40)) for s in (None, "a", "a", "a", "b") for _ in range(6)] + [("c", None)]
    want = [(s, rng.choice([None, *range(45)]), rng.choice([None, *range(45)])) for s in (None, "a", "b", "c", "d") for _ in range(25)]
    d = spark.createDataFrame([(s, day(k)) for s, k in have], "s string, d date")
    t = spark.createDataFrame([(i, s, day(a), day(b)) for i, (s, a, b) in enumerate(want)], "i int, s string, target date, low date")
    for after in (None, "low"):
        got = {r.i: r.nearest for r in joins.nearest_date(t, d, by=["s"], after=after).collect()}
        for i, (s, a, b) in enumerate(want):
            fit = [k for z, k in have if z == s and k is not None and (after is None or (b is not None and k > b))]
            best = min(fit, key=lambda k: (abs(k - a), k)) if fit and a is not None else None
            assert got[i] == day(best), (i, s, a, b)
    assert joins.nearest_date(t, d.limit(0), by=["s"]).where("nearest is not null").isEmpty()


def test_nearest_date_of_a_million_days(spark):
    start = F.to_date(F.lit("0001-01-01"))
    d = spark.range(0, 3_000_000, 3).select(F.date_add(start, F.col("id").cast("int")).alias("d"))
    t = spark.range(0, 2_999_990, 1499).select("id", F.date_add(start, F.col("id").cast("int")).alias("target"))
    off = F.datediff("nearest", start) - 3 * F.round(F.col("id") / 3)
    assert joins.nearest_date(t, d).agg(F.sum(F.abs(off)), F.count("nearest")).first()[:] == (0, t.count())


def test_resamplers_keep_passes_apart(spark):
    src = spark.createDataFrame([(p, 0, 0, float(p)) for p in (1, 2)], "pass int, r int, c int, value double")
    fine = src.selectExpr("pass", "explode(array(0, 1)) AS r", "c")
    near = joins.resample_nearest(src, fine, 2, ["pass"])
    flat = joins.resample_bilinear(src, fine, 2, ["pass"])
    for out in (near, flat):
        assert sorted((r["pass"], r.r, r.value) for r in out.collect()) == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 2.0), (2, 1, 2.0)]


def test_copies_give_one_row_each(spark):
    p = spark.createDataFrame([(i, 5, 1.0) for i in range(50)] + [(99, 6, 1.0)], "code long, n long, total double")
    got = joins.duplicate_inputs(p, "code", ["n", "total"]).collect()
    assert len(got) == 49 and {r.first_input for r in got} == {0}


def test_bilinear_against_direct_formula(spark):
    coarse = {(r, c): float(3 * r + c * c) for r in range(3) for c in range(3)}
    src = spark.createDataFrame([(r, c, v) for (r, c), v in coarse.items()], "r long, c long, value double")
    fine = spark.createDataFrame([(r, c) for r in range(12) for c in range(12)], "r long, c long")
    for row in joins.resample_bilinear(src, fine, 4).collect():
        y, x = (row.r + 0.5) / 4 - 0.5, (row.c + 0.5) / 4 - 0.5
        num = den = 0.0
        for a in (0, 1):
            for b in (0, 1):
                w = (y - math.floor(y) if a else 1 - y + math.floor(y)) * (x - math.floor(x) if b else 1 - x + math.floor(x))
                v = coarse.get((math.floor(y) + a, math.floor(x) + b))
                if v is not None:
                    num, den = num + w * v, den + w
        assert row.value == pytest.approx(num / den)


def test_mask_is_cut_at_one_half(spark):
    mask = spark.createDataFrame([(0, 0, True), (0, 1, False)], "r long, c long, valid boolean")
    fine = spark.createDataFrame([(1, c) for c in range(8)], "r long, c long")
    got = {r.c: r.valid for r in joins.resample_mask(mask, fine, 4).collect()}
    assert [got[c] for c in range(8)] == [True] * 4 + [False] * 4


# -- geometry ---------------------------------------------------------------------------------
SHAPES = {
    1: [[(0.0, 0.0), (9.0, 1.0), (10.0, 8.0), (4.0, 4.0), (1.0, 9.0)]],            # concave
    2: [[(20.0, 0.0), (24.0, 0.0), (24.0, 3.0), (20.0, 3.0)], [(30.0, 5.0), (36.0, 5.0), (33.0, 11.0)]],
    3: [[(5.0, 20.0), (5.0, 20.0), (5.0, 20.0)]]}                                  # no area


def shapes(spark):
    return spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in ring] for ring in parts]) for i, parts in SHAPES.items()],
                                 "plot_id long, parts array<array<struct<x: double, y: double>>>")


def inside(parts, x, y):
    hit = False
    for ring in parts:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y < y2 or y2 <= y < y1) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                hit = not hit
    return hit


def test_cells_in_polygons_against_ray_casting(spark):
    got = {(r.plot_id, r.r, r.c) for r in geometry.cells_in_polygons(shapes(spark)).collect()}
    want = {(i, r, c) for i, p in SHAPES.items() for r in range(25) for c in range(40) if inside(p, c + 0.5, r + 0.5)}
    assert got == want


def test_core_cells_against_distances(spark):
    erode = {r.plot_id: r.erode for r in geometry.polygon_measures(shapes(spark)).collect()}

    def far(parts, x, y, e):
        for ring in parts:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                n = (x2 - x1) ** 2 + (y2 - y1) ** 2
                u = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0
                if math.hypot(x - x1 - u * (x2 - x1), y - y1 - u * (y2 - y1)) < e:
                    return False
        return True

    got = {(r.plot_id, r.r, r.c) for r in geometry.core_cells(shapes(spark)).collect()}
    want = {(i, r, c) for i, p in SHAPES.items() for r in range(25) for c in range(40)
            if inside(p, c + 0.5, r + 0.5) and far(p, c + 0.5, r + 0.5, erode[i])}
    assert got == want and erode[3] == 0.0


def test_measures_of_parts(spark):
    got = {r.plot_id: r for r in geometry.polygon_measures(shapes(spark)).collect()}
    assert got[2].area == pytest.approx(12 + 18)
    assert got[2].cx == pytest.approx((12 * 22 + 18 * 33) / 30)
    assert (got[3].area, got[3].cx, got[3].cy) == (0.0, 5.0, 20.0)


def test_overlap_centroid_and_outside(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 2)], "plot_id long, r long, c long")
    regions = spark.createDataFrame([(0, 0, "A"), (0, 1, "B"), (0, 2, "B"), (5, 5, "A")], "r long, c long, region string")
    centroids = spark.createDataFrame([(1, 1.5, 0.5), (2, 5.2, 5.7), (3, 50.0, 50.0)], "plot_id long, cx double, cy double")
    a = geometry.largest_overlap(cells, regions, centroids)
    assert {r.plot_id: (r.region, r.how) for r in a.collect()} == {1: ("B", "area"), 2: ("A", "centroid"), 3: (None, "outside")}
    said = spark.createDataFrame([(1, "B", 3.0), (2, "B", 1.0), (3, "A", 2.0)], "plot_id long, region string, weight double")
    r = one(geometry.containment(a, said))
    assert (r.n_agree, r.n_disagree, r.n_by_centroid, r.n_outside, r.weight_outside) == (1, 1, 1, 1, 2.0)


# -- text -------------------------------------------------------------------------------------
def test_tokens_and_trace(spark):
    docs = spark.createDataFrame([(1, "total 893.92 over 1,234 plots, rho 0.15 and 1e-3, 0.50")], "doc int, text string")
    tok = text.numeric_tokens(docs)
    assert {r.token for r in tok.collect()} == {"893.92", "1234", "0.15", "1e-3", "0.50"}
    log = spark.createDataFrame([(1, "n=1234\nrho 0.1494 then 0.1451\nsum 893.9249, p 11e-34, 0.495")], "page int, text string")
    got = {r.token: (r.line_no, r.how) for r in text.trace_tokens(tok, text.lines_of(log, "page"), "page").collect()}
    assert got == {"1234": (0, "verbatim"), "0.15": (1, "rounded"), "893.92": (2, "verbatim"), "1e-3": (2, "verbatim"), "0.50": (2, "rounded")}


def test_fixed_text_rounds_half_up(spark):
    d = spark.createDataFrame([("0.995", 2), ("12.3449", 2), ("7.5", 3), ("0.04", 1), ("99.96", 1)], "n string, p int")
    assert [r[0] for r in d.select(text.fixed_text(F.col("n"), F.col("p"))).collect()] == ["1.00", "12.34", "7.500", "0.0", "100.0"]


def test_pattern_guard(spark):
    f = spark.createDataFrame([("a", "x\nndvi_R1 here"), ("b", "ndvi_R12"), ("c", "ndvi_R2")], "name string, text string")
    allow = spark.createDataFrame([("c",)], "name string")
    assert [(r.name, r.first_line) for r in text.pattern_guard(f, r"ndvi_(?:R1|R2)\b", allow, "name").collect()] == [("a", 2)]


# -- sources and jobs -------------------------------------------------------------------------
def test_missing_offsets_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_offsets(spark, str(tmp_path / "none"))


def test_fill_value_fails_the_read(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"source": "a", "parameter": {"20250101": 1.5, "20250102": -999.0}}\n')
    with pytest.raises(Exception, match="fill value at 20250102"):
        io.read_daily(spark, str(tmp_path)).collect()


def test_catalogue_counts_missing_cloud_as_full(spark, tmp_path):
    (tmp_path / "c.json").write_text("""{"features": [
        {"id": "s1", "properties": {"datetime": "2025-10-13T05:00:00Z"}, "assets": {"red": {"href": "u"}}},
        {"id": "s2", "properties": {"datetime": "2025-10-14T05:00:00Z", "eo:cloud_cover": 3.5}, "assets": {}}]}""")
    got = io.least_cloudy_first(io.read_catalogue(spark, str(tmp_path))).collect()
    assert [(r.id, r.cloud) for r in got] == [("s2", 3.5), ("s1", 100.0)]


def test_whole_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert one(io.read_text(spark, str(tmp_path), whole=True)).value == "one\ntwo"


def test_forecast_outside_its_band_fails(spark):
    d = season(spark, *[(i, None, (1.0, float(i), 1.0)) for i in range(1, 7)]).drop("cls")
    p = spark.createDataFrame([(i, "Maize") for i in range(1, 7)], "plot_id long, cls string")
    ok = jobs.job_forecast(d, p, CALENDAR, REFERENCE, {"Maize": (0.5, 9.0)})
    assert ok.count() == 6
    with pytest.raises(gates.GateError, match="outside_band"):
        jobs.job_forecast(d, p, CALENDAR, REFERENCE, {"Maize": (2.0, 2.1)})


def test_tally_follows_the_entries(spark):
    d = spark.createDataFrame([(1, "held"), (2, "not met"), (3, "held")], "n int, verdict string")
    r = one(rollup.tally(d, ["held", "contradicted", "not met"]))
    assert (r.held, r.contradicted, r.not_met) == (2, 0, 1)
