"""Ordered operators against brute force, with a third of all rows in one group or on one value."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import ordered

RNG = random.Random(5)


def skewed(n=3000):
    """(id, g, v, w): group 0 has a third of the rows, value 7.0 another third."""
    out = []
    for i in range(n):
        g = 0 if i % 3 == 0 else RNG.randrange(1, 6)
        v = 7.0 if i % 3 == 1 else round(RNG.uniform(-5, 20), 2)
        out.append((i, g, v, float(RNG.randrange(1, 9))))
    return out


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g int, v double, w double").repartition(7)


def test_running_sums_match_a_global_order(df, rows):
    got = {r.id: r.cum for r in ordered.running_sums(df, [], ["v", "id"], {"cum": F.col("w")}).collect()}
    total = 0.0
    for i, _, _, w in sorted(rows, key=lambda r: (r[2], r[0])):
        total += w
        assert got[i] == pytest.approx(total)


def test_running_sums_restart_per_group(df, rows):
    got = {r.id: r.cum for r in ordered.running_sums(df, ["g"], ["v", "id"], {"cum": F.col("w")}).collect()}
    for g in range(6):
        total = 0.0
        for i, _, _, w in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            total += w
            assert got[i] == pytest.approx(total)


def test_average_rank_shares_ties(df, rows):
    got = {r.id: r.avg_rank for r in ordered.average_rank(df, "v").collect()}
    values = np.array([r[2] for r in rows])
    for i, _, v, _ in rows[::37]:
        assert got[i] == (values < v).sum() + ((values == v).sum() + 1) / 2


def test_average_rank_of_null_is_null(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id int, v double")
    assert {r.id: r.avg_rank for r in ordered.average_rank(d, "v").collect()} == {1: 2.0, 2: None, 3: 1.0}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact(df, rows, accuracy, monkeypatch):
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", accuracy)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "v", probs).collect()}
    for g in range(6):
        want = np.quantile([r[2] for r in rows if r[1] == g], list(probs.values()))
        assert [got[g][k] for k in probs] == pytest.approx(list(want))


def test_quantiles_stay_exact_when_the_sketch_brackets(spark, monkeypatch):
    """Groups larger than the sketch accuracy keep only bracketed rows."""
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 200)
    d = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(
        F.sqrt(F.col("id"))).alias("v"), (F.col("id") % 2).alias("g"))
    got = {r.g: r for r in ordered.quantiles(d, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}).collect()}
    x = np.array([5.0 if i % 3 == 0 else i ** 0.5 for i in range(20000)])
    for g in (0, 1):
        assert [got[g][k] for k in ("lo", "mid", "hi")] == pytest.approx(
            list(np.quantile(x[np.arange(20000) % 2 == g], [0.05, 0.5, 0.95])))


def brute_cut(rows, prior, labels):
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    total = sum(r[3] for r in rows)
    edges, run = [], 0.0
    for p in prior[:-1]:
        run += p / sum(prior)
        edges.append(run)
    out, cum = {}, 0.0
    for i, _, _, w in order:
        cum += w
        out[i] = labels[sum(e < cum / total for e in edges)]
    return out


def test_share_cut_against_brute_force_and_row_order(df, rows):
    prior, labels = (0.08, 0.18, 0.16), ("x", "y", "z")
    want = brute_cut(rows, prior, labels)
    for parts in (1, 3, 11):
        d = df.repartition(parts).orderBy(F.rand(parts))
        got = ordered.share_cut(d, "v", "id", "w", prior, labels)
        assert {r.id: r.bucket for r in got.collect()} == want


def test_null_safe_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, x int")
    b = spark.createDataFrame([(None, "n"), (2, "t")], "k int, y string")
    got = ordered.null_safe_join(a, b, ["k"]).collect()
    assert {(r.k, r.x, r.y) for r in got} == {(None, 1, "n"), (2, 2, "t")}


def test_attach_keeps_every_row(df, rows):
    got = ordered.attach(df, ["g"], {"m": F.avg("w")})
    assert got.count() == len(rows)
