"""Core cells against every cell's distance to every edge, on ragged plots."""

from __future__ import annotations

import numpy as np
import pytest

from fieldspark.operators import geometry

SCHEMA = "plot_id long, parts array<array<struct<x: double, y: double>>>"


def ragged(rng, n, scale):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.3, 1.0, n) * scale
    mid = rng.uniform(-50, 50, 2)
    return [(float(mid[0] + a), float(mid[1] + b)) for a, b in zip(far * np.cos(angle), far * np.sin(angle))]


def comb(teeth):
    pts = [(0.0, -12.0)]
    for t in range(teeth):
        pts += [(6.0 * t, 30.0), (6.0 * t + 3.0, 30.0), (6.0 * t + 3.0, 0.5), (6.0 * t + 6.0, 0.5)]
    return [*pts, (6.0 * teeth, -12.0)]


def brute(rings, erode, cell):
    edges = [(np.array(a), np.array(b)) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    xs, ys = zip(*[p for ring in rings for p in ring])
    inside, core = set(), set()
    for r in range(int(min(ys) // cell) - 1, int(max(ys) // cell) + 2):
        for c in range(int(min(xs) // cell) - 1, int(max(xs) // cell) + 2):
            x, y = (c + 0.5) * cell, (r + 0.5) * cell
            odd, near = False, False
            for a, b in edges:
                lo, hi = min(a[1], b[1]), max(a[1], b[1])
                if lo <= y < hi and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= x:
                    odd = not odd
                d, q = b - a, np.array([x, y])
                t = 0.0 if not (d @ d) else min(1.0, max(0.0, float((q - a) @ d / (d @ d))))
                near |= bool(np.hypot(*(q - a - t * d)) < erode)
            if odd:
                inside.add((r, c))
                if not near:
                    core.add((r, c))
    return core or inside


@pytest.mark.parametrize("cell", [1.0, 2.5])
def test_ragged_plots_equal_brute_force(spark, cell):
    rng = np.random.default_rng(8)
    shapes = {i: [ragged(rng, int(n), s)] for i, (n, s) in enumerate([(3, 20), (7, 30), (25, 40), (40, 12), (5, 2), (12, 35)])}
    shapes[10] = [comb(4)]
    shapes[11] = [[(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (0.0, 30.0)], [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]]
    shapes[12] = [[(0.0, 0.0), (0.0, 0.0), (17.0, 0.0), (17.0, 11.0), (0.0, 11.0)]]
    plots = spark.createDataFrame([(k, v) for k, v in shapes.items()], SCHEMA)
    erode = {r.plot_id: r.erode for r in geometry.polygon_measures(plots).collect()}
    got = {k: set() for k in shapes}
    rows = geometry.core_cells(plots, cell).collect()
    for r in rows:
        got[r.plot_id].add((r.r, r.c))
    assert sum(map(len, got.values())) == len(rows)
    for k, rings in shapes.items():
        assert got[k] == brute(rings, erode[k], cell), k


def test_plots_without_area_or_rows(spark):
    plots = spark.createDataFrame([(1, [[(0.0, 0.0), (5.0, 5.0)]]), (2, []), (3, None)], SCHEMA)
    assert geometry.core_cells(plots).where("plot_id > 1").count() == 0
    assert geometry.core_cells(plots.limit(0)).collect() == []


def test_a_large_plot_meets_few_rows(spark):
    """Intervals, not cells, meet edges: a thousandfold area costs rows of its height only."""
    ring = [(0.0, 0.0), (3000.0, 0.0), (3000.0, 900.0), (0.0, 900.0)]
    plots = spark.createDataFrame([(1, [ring])], SCHEMA)
    edges = geometry.edges_of(plots).join(geometry.polygon_measures(plots).select("plot_id", "erode"), "plot_id")
    assert geometry.ruled_out(edges, 1.0, "plot_id").count() < 4 * 920
    assert geometry.core_cells(plots).count() == 2992 * 892
