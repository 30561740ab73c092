"""Many fits at once: what a settled fit has to satisfy, checked by SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import cluster, kmeans, rollup
from fieldspark.plans import bindings as B
from fieldspark.plans import jobs
from fieldspark.plans.q_jobs import label_frame
from fieldspark.plans.q_series import CUT_LABELS, CUT_PRIOR
from fieldspark.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return rollup.zscore(B.vectors(Tables(spark, FOLDER)), B.DIMS).select("plot_id", *B.DIMS).cache()


def test_every_point_is_at_its_nearest_centre_and_centres_are_means(spark, data):
    con = duckdb.connect()
    con.register("x", data.toArrow())
    con.register("runs", cluster.kmeans_runs(data, B.DIMS, 5, list(range(6)), 3).toArrow())
    means = ", ".join(f"avg({c}) AS {c}" for c in B.DIMS)
    gap = " + ".join(f"(x.{c} - m.{c}) ** 2" for c in B.DIMS)
    n, far, missing = con.execute(f"""WITH m AS (SELECT run, cluster, {means} FROM runs JOIN x USING (plot_id) GROUP BY 1, 2),
d AS (SELECT r.run, plot_id, min({gap}) AS least, min({gap}) FILTER (m.cluster = r.cluster) AS own FROM runs r JOIN x USING (plot_id) JOIN m ON m.run = r.run GROUP BY 1, 2)
SELECT count(*), count(*) FILTER (own > least + 1e-9), 6 * (SELECT count(*) FROM x) - count(*) FROM d""").fetchone()
    assert n and not far and not missing


def test_more_seeds_change_no_fit_and_partitions_neither(data):
    few = {(r.run, r.plot_id): r.cluster for r in cluster.kmeans_runs(data, B.DIMS, 4, [0, 1], 3).collect()}
    many = {(r.run, r.plot_id): r.cluster for r in cluster.kmeans_runs(data.repartition(7), B.DIMS, 4, [0, 1, 2, 3], 3).collect()}
    assert few == {k: v for k, v in many.items() if k[0] < 2}


def test_groups_far_apart_are_found(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(20 * (i % 4) + rng.normal()), float(rng.normal())) for i in range(400)]
    got = cluster.kmeans_runs(spark.createDataFrame(rows, "plot_id long, a double, b double"), ["a", "b"], 4, [5], 10).collect()
    assert len({(r.plot_id % 4, r.cluster) for r in got}) == 4 and len({r.cluster for r in got}) == 4


def test_odd_rows(spark):
    schema = "plot_id long, a double, h string"
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 1.0, "x"), (3, None, "x"), (4, float("nan"), "x"), (None, 5.0, None)], schema)
    got = cluster.kmeans_runs(df, ["a"], 3, [0], 2).collect()
    assert {r.plot_id for r in got} == {1, 2, None} and len({r.cluster for r in got if r.plot_id}) == 1
    assert kmeans.kmeans_grid(df.limit(0), ["a"], {2: [0]}, 2).collect() == []


def test_jobs_do_not_grow_with_seeds(spark, data):
    def jobs_of(seeds):
        group = f"seeds-{len(seeds)}"
        spark.sparkContext.setJobGroup(group, group)
        points = kmeans.points_of(data, B.DIMS, "plot_id")
        kmeans.settled(points, kmeans.seeded(points, 4, np.array(seeds) * 4099), rounds=3)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs_of(range(2)) == jobs_of(range(30))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stability_equals_one_setting_at_a_time(spark):
    frame = label_frame(Tables(spark, FOLDER)).cache()
    how = dict(level="e2", drop="e4", end="canopy_end", end_min=0.15)
    settings = [(5, 2)]
    got = {(r.k, r.seeds): r for r in jobs.label_stability(frame, B.DIMS, "e7", CUT_PRIOR, CUT_LABELS, (4, 2), settings, 2, **how).collect()}
    alone = {(k, n): {r.plot_id: (r.cls, r.confidence, r.margin) for r in jobs.job_labels(frame, B.DIMS, "e7", CUT_PRIOR, CUT_LABELS, k=k, seeds=range(n), inits=2, **how).collect()}
             for k, n in [(4, 2), *settings]}
    assert got.keys() == set(settings)
    for at, r in got.items():
        a, b = alone[4, 2], alone[at]
        assert a.keys() == b.keys() and r.n == len(a) == frame.count()
        sure = [p for p in a if a[p][1] == b[p][1] == "high"]
        assert r.agreement == pytest.approx(sum(a[p][0] == b[p][0] for p in a) / len(a))
        assert r.n_sure == len(sure) and r.agreement_sure == pytest.approx(sum(a[p][0] == b[p][0] for p in sure) / len(sure))
    assert frame.where(F.col("screened")).count() > 0


def test_a_small_file_is_dealt_over_the_cores(spark, data):
    one = data.repartition(1)
    points = kmeans.points_of(one, B.DIMS, "plot_id")
    sizes = [r["n"] for r in points.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) <= sum(sizes) / 2


def test_cluster_counts_share_their_scans(spark, data):
    def scans_of(seeds):
        group = f"counts-{len(seeds)}"
        spark.sparkContext.setJobGroup(group, group)
        grid = kmeans.kmeans_grid(data, B.DIMS, seeds, 2)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, {(r.k, r.seed, r.plot_id): r.cluster for r in grid.collect()}

    alone = {k: scans_of({k: [0, 1]}) for k in (3, 5)}
    n, got = scans_of({3: [0, 1], 5: [0, 1], 4: [1]})
    assert n < alone[3][0] + alone[5][0]
    for _, want in alone.values():
        assert want.items() <= got.items()
    assert {(k, s) for k, s, _ in got} == {(3, 0), (3, 1), (5, 0), (5, 1), (4, 1)}


@pytest.mark.parametrize("k", [1, 2, 5, 12, 13, 130])
def test_single_precision_never_decides_what_it_cannot_tell(k):
    rng = np.random.default_rng(k)
    x = np.vstack([rng.normal(size=(700, 6)), 1e-25 * rng.normal(size=(20, 6)), 1e39 * rng.normal(size=(20, 6)), np.zeros((3, 6))])
    centres = rng.normal(size=(150, k, 6))
    centres[1] = centres[1, :1]                                          # all equal: the first one
    centres[2, -1] = centres[2, 0]
    centres[3] = centres[3, :1] + 1e-9 * rng.normal(size=(k, 6))         # closer than single precision tells
    centres[4, 0] = 1e25
    gap = x[:, None, None] - centres
    want = (gap * gap).sum(3).argmin(2).T
    base, kind = kmeans.code_of(k)
    got = kmeans.Screen(centres, base, kind).own(x)
    assert got.dtype == kind and (got.astype(np.int64) - base == want).all()


def test_steps_by_changed_points_are_lloyds(spark, data):
    rows = np.array([r["x"] for r in kmeans.points_of(data, B.DIMS, "plot_id").select("x").collect()])
    starts = [rows[np.random.default_rng(k).integers(0, len(rows), (3, k))] for k in (4, 7)]
    points, kept = kmeans.points_of(data, B.DIMS, "plot_id").select("x"), spark.sparkContext._jsc.getPersistentRDDs().size()
    for at, (got, cost) in zip(starts, kmeans.settled_groups(points, starts, 14)):
        for c, g, paid in zip(at, got, cost):
            for _ in range(14):
                far = ((rows[:, None] - c) ** 2).sum(2)
                own, last = far.argmin(1), far.min(1).sum()
                c = np.array([rows[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
            assert np.allclose(c, g, atol=1e-9) and paid == pytest.approx(last)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
