"""End-to-end jobs on small frames: the parts that the SQL checks do not reach."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import gates
from fieldspark.plans import jobs
from fieldspark.sources.stage import clear_stages, materialise

PRIOR, LABELS = (0.08, 0.18, 0.16), ("Bajra", "Maize", "Groundnut")


def frame(spark, n=90):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        kind = i % 3
        rows.append((i, rng.gauss(5 * (kind == 0), 0.3), rng.gauss((-2, 0, 6)[kind], 0.3), rng.uniform(-3, 3),
                     rng.uniform(0, 1000), rng.uniform(0, 1000), 0.1 + rng.random(), 0.0, i % 10 == 9))
    return spark.createDataFrame(rows, "plot_id long, level_T3 double, d34 double, axis double, x double, y double,"
                                       " weight double, canopy_end double, screened boolean")


def test_labels_from_kmeans_find_the_clear_signatures(spark):
    f = frame(spark)
    out = {r.plot_id: r for r in jobs.job_labels(f, ["level_T3", "d34"], "axis", PRIOR, LABELS, k=3, seeds=(1, 2)).collect()}
    assert len(out) == 90
    for i, r in out.items():
        if r.screened:
            assert r.confidence == "low"
        elif i % 3 == 0:
            assert (r.cls, r.confidence, r.tier2) == ("Rice", "high", False)
        elif i % 3 == 2:
            assert (r.cls, r.confidence, r.tier2) == ("Cotton", "high", False)
        else:
            assert r.cls in LABELS and r.confidence == "low" and r.tier2


def test_labels_do_not_depend_on_row_order(spark):
    f = frame(spark)
    runs = f.where("not screened").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("run"), "plot_id",
                                          (F.col("plot_id") % 3).cast("int").alias("cluster"))
    got = [{r.plot_id: r.cls for r in jobs.job_labels(d, ["level_T3", "d34"], "axis", PRIOR, LABELS, runs=runs).collect()}
           for d in (f, f.repartition(5).orderBy(F.rand(4)))]
    assert got[0] == got[1]


def plots(spark):
    rows = [(i, "ab"[i % 2], 1.00004 + i, 1.5, 0.1, 1.2, "high", 10.0 * i, 0.0, "measured") for i in range(1, 31)]
    return spark.createDataFrame(rows, "plot_id long, cls string, weight double, value double, fraction double,"
                                       " reference double, confidence string, x double, y double, data_quality string")


COLUMNS = ["plot_id", "cls", "weight", "value", "production"]
BANDS = {"a": (0.5, 2.0), "b": (0.5, 2.0)}


def test_shipping_reconciles_rounded_rows(spark):
    out = jobs.job_ship(plots(spark), COLUMNS, BANDS, ["a", "b"])
    total = out["plots"].agg(F.sum("production")).first()[0]
    assert out["summary"].where("cls = 'ALL'").first().production == pytest.approx(total, abs=1e-9)
    assert out["plots"].columns == COLUMNS
    assert all(r.n >= 5 for r in out["zones"].collect())


@pytest.mark.parametrize("disagree, outside, name", [(1, 0.0, "n_disagree"), (0, 0.5, "outside")])
def test_shipping_stops_when_plots_are_not_contained(spark, disagree, outside, name):
    c = spark.createDataFrame([(disagree, outside)], "n_disagree long, weight_outside double")
    with pytest.raises(gates.GateError, match=name):
        jobs.job_ship(plots(spark), COLUMNS, BANDS, ["a", "b"], c)


def test_features_take_neighbours_only_where_data_lack(spark):
    doys = {p: float(10 * p) for p in range(6)}
    cells, places = [], []
    for i in range(12):
        places.append((i, float(i), 0.0, 2))
        for p in range(6 if i else 2):
            cells += [(i, p, 10.0 ** (1 + 0.1 * i)), (i, p, 10.0 ** (1 + 0.1 * i))]
    c = spark.createDataFrame(cells, "plot_id long, pass int, value double")
    s = spark.createDataFrame(places, "plot_id long, x double, y double, core_cells int")
    off = spark.createDataFrame([(0, 0.0)], "pass int, offset double")
    got = {(r.plot_id, r["pass"]): r for r in jobs.job_features(c, s, doys, off).collect()}
    assert got[3, 2].v == pytest.approx(13.0) and got[3, 2].data_quality == "measured" and got[3, 2].donor_dist is None
    assert got[0, 4].v == pytest.approx(10 + 4.5) and got[0, 4].data_quality == "imputed"
    assert got[0, 4].donor_dist == pytest.approx(4.5)


def test_stage_tables_can_be_cleared(spark):
    d = materialise(spark.range(5))
    assert d.count() == 5
    clear_stages(spark)
    with pytest.raises(Exception):
        d.count()
