"""Resampling and sensitivity as single jobs keyed by draw or scenario, never a driver loop.

Every random number is a portable hash of (row id, draw, seed). Row-by-draw products end in a
partial aggregate per draw, so what is shuffled is draws x tasks, not draws x rows, wherever the
statistic allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rand
from fieldspark.functions.expr import clip, lookup, nan_to_null
from fieldspark.operators.classdraws import Matrices, class_totals, class_weights, first_beyond, mix52, normal
from fieldspark.operators.draws import block_rhos, permuted_arrays, permuted_products
from fieldspark.operators.joins import swap_label, with_draws
from fieldspark.operators.ordered import (attach, cumulative_share, join_stats, null_safe_join,
                                          positions, prior_edges, quantiles, running_sums,
                                          share_label)
from fieldspark.operators.rollup import centred_factor, stack
from fieldspark.operators.stats import morans_i, spearman
from fieldspark.sources.stage import materialise


def over_draws(df: DataFrame, value: str, names: Mapping[str, float],
               by: Sequence[str] = ()) -> DataFrame:
    """Quantiles over draws: one value per draw, so the group is as small as the draw count."""
    return df.groupBy(*by).agg(*[F.percentile(value, p).alias(n) for n, p in names.items()])


def bootstrap_skill(errors: DataFrame, draws: int = 2000, seed: int = 11,
                    by: Sequence[str] = ()) -> DataFrame:
    """Interval of the skill score over row resamples (Poisson resampling weights)."""
    e = materialise(errors.select(*by, "plot_id", "e_model", "e_base"))
    d = with_draws(e, draws).withColumn("_u", rand.uniform(F.col("plot_id"), F.col("draw"), seed))
    s = d.withColumn("_w", rand.poisson1(F.col("_u"))).groupBy(*by, "draw").agg(
        F.sum(F.col("_w") * F.col("e_model") * F.col("e_model")).alias("_m"),
        F.sum(F.col("_w") * F.col("e_base") * F.col("e_base")).alias("_b"))
    s = s.withColumn("skill", F.when(F.col("_b") > 0, 1.0 - F.col("_m") / F.col("_b")))
    return over_draws(s, "skill", {"ci_lo": 0.025, "ci_hi": 0.975}, by)


def block_bootstrap(df: DataFrame, a: str, b: str, draws: int = 999, size: float = 500.0,
                    seed: int = 12) -> DataFrame:
    """Rank correlation with an interval from resampling whole map cells.

    A cell's resampling weight counts all its plots that often, so copies are never written out,
    and plots are ordered once for all draws.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("x").isNotNull()
                 & F.col("y").isNotNull())
    d = materialise(d.select("plot_id", a, b, (F.floor(F.col("x") / size) * 100000
                                               + F.floor(F.col("y") / size)).alias("block")))
    known = d.where(nan_to_null(F.col(a).cast("double")).isNotNull() & nan_to_null(F.col(b).cast("double")).isNotNull())
    rho = block_rhos(known, a, b, draws, seed)
    ends = over_draws(rho, "rho", {"lo": 0.025, "hi": 0.975})
    blocks = d.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    sizes = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("_n").alias("n"))
    med = quantiles(blocks, [], "_n", {"median_block_n": 0.5})
    point = spearman(d, a, b).select("rho")
    out = null_safe_join(null_safe_join(sizes, med, []), point, [])
    return null_safe_join(out, ends, [])


def permuted_values(points: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, plot_id, v): the values dealt again at random, once per draw, as rows."""
    def split(frames):
        for f in frames:
            yield pd.DataFrame({"plot_id": f["plot_id"], "v": [np.frombuffer(x) for x in f["vs"]]})

    arrays = permuted_arrays(points, draws, seed)
    kind = arrays.schema["plot_id"].dataType.simpleString()
    return arrays.mapInPandas(split, f"plot_id {kind}, v array<double>").select(
        "plot_id", F.posexplode("v").alias("draw", "v")).select("draw", "plot_id", "v")


def permutation_morans(points: DataFrame, edges: DataFrame, draws: int = 999,
                       seed: int = 13, where: DataFrame | None = None) -> DataFrame:
    """Observed Moran's I, mean of the permuted ones, exceedances and the p value.

    ``where(plot_id, x, y)`` keeps plots that are near each other together; it changes no result.
    """
    edges = materialise(edges.select("plot_id", "donor_id", "w"))
    observed = morans_i(points.select("plot_id", "v"), edges)
    known = points.select("plot_id", nan_to_null(F.col("v").cast("double")).alias("v")).where("v is not null")
    centred = materialise(attach(known, [], {"_m": F.avg("v")}).select("plot_id", (F.col("v") - F.col("_m")).alias("v")))
    # A permutation moves the values only, so the sum of squares is the same in every draw.
    squares = centred.agg(F.sum(F.col("v") * F.col("v")).alias("_den"))
    sums = permuted_products(centred, edges, draws, seed, where)
    null = null_safe_join(sums, squares, []).select(F.try_divide(F.col("s"), F.col("_den")).alias("morans_i"))
    j = null_safe_join(null.select(F.col("morans_i").alias("_null")),
                       observed.select(F.col("morans_i").alias("observed")), [])
    out = j.groupBy("observed").agg(F.avg("_null").alias("null_mean"),
                                    F.count_if(F.col("_null") >= F.col("observed")).alias("exceed"),
                                    F.count(F.lit(1)).alias("draws"))
    p = (1.0 + F.col("exceed")) / (F.col("draws") + 1.0)
    text = F.concat(F.when(F.col("exceed") == 0, "p<").otherwise("p="), F.format_string("%.3f", p))
    return out.withColumns({"p": p, "shown": text})


def tie_parts(df: DataFrame, axis: str, weight: str, prior: Sequence[float], labels: Sequence[str],
              draws: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Staged (plot_id, k, run, _pw, ...) of all rows, and per run of equal keys that straddles an edge,
    edge and draw the first (number, plot_id) beyond the edge.

    ``k`` is the label of a row whose run lies between edges; a row of run 0, 1, ... takes its label in
    every draw by comparing its random number with those. No other row can change its label.
    """
    runs = df.groupBy(axis).agg(F.sum(weight).cast("double").alias("_w"))
    runs = attach(runs, [], {"_total": F.sum("_w")})
    runs = running_sums(runs, [], [axis], {"_hi": F.col("_w")})
    edges = prior_edges(prior)
    hi = F.col("_hi") / F.col("_total")
    lo = (F.col("_hi") - F.col("_w")) / F.col("_total")
    crossed = sum((F.when((e > lo) & (e < hi), 1).otherwise(0) for e in edges), F.lit(0))
    first = F.when(crossed > 0, F.struct((F.col("_hi") - F.col("_w")).alias("before"), F.col("_total").alias("total"), F.col(axis).alias("axis")))
    runs = materialise(runs.select(axis, sum((F.when(e < hi, 1).otherwise(0) for e in edges), F.lit(0)).alias("k"), first.alias("_s")))
    # There are no more such runs than edges.
    split = sorted((r["_s"] for r in runs.where("_s is not null").select("_s").collect()), key=lambda s: s["before"])
    number = sum((F.when(F.col("_s.before") == s["before"], F.lit(i + 1)).otherwise(0) for i, s in enumerate(split)), F.lit(0)) - 1
    placed = runs.select(axis, "k", number.cast("int").alias("run"))
    kept = [c for c in df.columns if c not in (axis, weight, "plot_id")]
    rows = materialise(join_stats(df.select("plot_id", axis, F.col(weight).cast("double").alias("_pw"), *kept), placed, [axis], "inner"))
    ends, whole = [], sum(float(p) for p in prior)
    for p in prior[:-1]:
        ends.append(float(p) / whole if not ends else ends[-1] + float(p) / whole)
    known = {i: (s["before"], s["total"]) for i, s in enumerate(split)}
    moving = rows.where("run >= 0").select("plot_id", "run", "_pw")
    return rows, first_beyond(moving, known, ends, draws, seed)


def tie_labels(f: pd.DataFrame, draw: np.ndarray, beyond: np.ndarray, seed: int) -> np.ndarray:
    """Label numbers, rows x draws."""
    k = np.repeat(f["k"].to_numpy()[:, None], len(draw), axis=1).astype(np.int64)
    run = f["run"].to_numpy()
    moving = np.flatnonzero(run >= 0)
    if len(moving):
        plot = f["plot_id"].to_numpy()[moving][:, None]
        h = mix52(plot, draw[None, :], seed)
        first = beyond[run[moving]][:, :, draw]
        k[moving] = sum(((h > first["h"][:, e]) | ((h == first["h"][:, e]) & (plot >= first["id"][:, e]))).astype(np.int64)
                        for e in range(beyond.shape[1]))
    return k


def tie_matrices(axis: str, prior: Sequence[float], labels: Sequence[str], reference: Mapping[str, float],
                 draws: int, seed: int, df: DataFrame, weight: str) -> tuple[DataFrame, Callable]:
    rows, beyond = tie_parts(df, axis, weight, prior, labels, draws, seed)
    worth = np.array([float(reference[x]) for x in labels])

    def spread(f: pd.DataFrame, draw: np.ndarray) -> Matrices:
        k, w = tie_labels(f, draw, beyond, seed), f["_pw"].to_numpy()[:, None]
        x = f["x"].to_numpy()[:, None] if "x" in f else w
        return k, x, worth[k] * w, w

    return rows, spread


def tie_permutation(df: DataFrame, axis: str, weight: str, prior: Sequence[float],
                    labels: Sequence[str], draws: int = 200, seed: int = 14) -> DataFrame:
    """(draw, bucket, weight): the ordered allocation with exact ties reordered at random.

    Only runs of equal keys that straddle an edge can change; rows of all other runs are summed
    once and shared by every draw.
    """
    rows, spread = tie_matrices(axis, prior, labels, dict.fromkeys(labels, 1.0), draws, seed, df.select("plot_id", axis, weight), weight)
    fixed = rows.where("run < 0").groupBy("k").agg(F.sum("_pw").alias("w"), F.count(F.lit(1)).alias("n"))
    fixed = with_draws(fixed, draws).select("draw", "k", "w", "n")
    moved = class_weights(rows.where("run >= 0"), spread, len(labels), draws)
    both = fixed.unionByName(moved).groupBy("draw", "k").agg(F.sum("w").alias("weight"), F.sum("n").alias("n"))
    return both.where("n > 0").select("draw", F.get(F.array(*[F.lit(x) for x in labels]), F.col("k")).alias("bucket"), "weight")


def tie_totals(df: DataFrame, axis: str, prior: Sequence[float], labels: Sequence[str], reference: Mapping[str, float],
               draws: int = 200, span: float = 0.30, seed: int = 14) -> DataFrame:
    """(draw, total): the forecast of allocated rows (plot_id, ``axis``, weight, x) with exact ties
    reordered at random; classes are centred anew in every draw."""
    plots = df.select("plot_id", axis, "weight", F.col("x").cast("double").alias("x"))
    rows, spread = tie_matrices(axis, prior, labels, reference, draws, seed, plots, "weight")
    return class_totals(rows, spread, len(labels), draws, span).select("draw", "total")


def tie_spread(per_draw: DataFrame) -> DataFrame:
    return per_draw.groupBy("bucket").agg(
        F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"),
        F.count(F.lit(1)).alias("draws"))


SPECKLE_DB = 4.34


def noise_draws(plots: DataFrame, draws: int = 1000, span: float = 0.30, seed: int = 15) -> DataFrame:
    """(draw, total): every plot's integral disturbed by its own speckle, recentred, summed."""
    sd = SPECKLE_DB / F.sqrt(F.greatest(F.col("cells"), F.lit(1.0)))
    names = materialise(plots.groupBy("cls").agg(F.count(F.lit(1)).alias("_n")))
    numbered = positions(names.select("cls"), [], ["cls"], "_k")
    rows = join_stats(plots.select("plot_id", "cls", F.col("x").cast("double").alias("x"), sd.alias("sd"), "reference", "weight"),
                      numbered, ["cls"], "inner")
    rows = materialise(rows.select("plot_id", (F.col("_k") - 1).alias("k"), "x", "sd",
                                   (F.col("reference") * F.col("weight")).cast("double").alias("rw")))

    def spread(f: pd.DataFrame, draw: np.ndarray) -> Matrices:
        k, x, sd, rw = (f[c].to_numpy()[:, None] for c in ("k", "x", "sd", "rw"))
        return k, x + sd * normal(f["plot_id"].to_numpy()[:, None], draw[None, :], seed), rw, rw

    if not (classes := names.count()):
        return rows.select(F.lit(0).alias("draw"), F.col("x").alias("total"))
    return class_totals(rows, spread, classes, draws, span).select("draw", "total")


def class_total(df: DataFrame, span: float, by: Sequence[str] = ()) -> DataFrame:
    f = centred_factor(df, "x", [*by, "cls"], span)
    return f.groupBy(*by).agg(
        F.sum(F.col("reference") * F.col("factor") * F.col("weight")).alias("total"))


def prior_draws(plots: DataFrame, axis: str, prior: Sequence[float], labels: Sequence[str],
                reference: Mapping[str, float], sigma: DataFrame, draws: int = 200,
                span: float = 0.30, seed: int = 16) -> DataFrame:
    """(draw, total, weight per label) under log-normal disturbances of the allocation prior.

    The cumulative share does not depend on the draw: rows are ordered once, and a draw only
    moves the edges they are compared with.
    """
    cut = cumulative_share(plots.select("plot_id", axis, "weight", "x"), axis, "plot_id", "weight")
    cut = materialise(null_safe_join(cut, sigma, []).select(
        *[F.col(c).cast("double").alias(c) for c in ("cum_share", "weight", "x", "sigma")]))
    worth = np.array([float(reference[x]) for x in labels])

    def spread(f: pd.DataFrame, draw: np.ndarray) -> Matrices:
        share, w, x = (f[c].to_numpy()[:, None] for c in ("cum_share", "weight", "x"))
        moved = [p * np.exp(f["sigma"].iloc[0] * normal(np.uint64(i + 1), draw, seed)) for i, p in enumerate(prior)]
        edge, k = 0.0, np.zeros((len(f), len(draw)), np.int64)
        for p in moved[:-1]:
            edge = edge + p / sum(moved)
            k += share > edge
        return k, x, worth[k] * w, w

    out = class_totals(cut, spread, len(labels), draws, span)
    return out.select("draw", "total", *[F.col("w")[i].alias(f"weight_{x}") for i, x in enumerate(labels)])


def threshold_sweep(df: DataFrame, column: str, levels: Sequence[float],
                    keep: Column | None = None) -> DataFrame:
    """Plots and weight at or above each level, in one scan."""
    ok = F.lit(True) if keep is None else keep
    names = []
    for i, lv in enumerate(levels):
        hit = (F.col(column) >= float(lv)) & ok
        names += [F.count_if(hit).alias(f"n{i}"), F.sum(F.when(hit, F.col("weight")).otherwise(0.0)).alias(f"w{i}")]
    one = df.agg(F.sum("weight").alias("_all"), *names)
    rows = F.array(*[F.struct(F.lit(float(lv)).alias("level"), F.col(f"n{i}").alias("n"),
                              F.col(f"w{i}").alias("weight")) for i, lv in enumerate(levels)])
    return one.select("_all", F.explode(rows).alias("_s")).select(
        "_s.level", "_s.n", "_s.weight", (F.col("_s.weight") / F.col("_all")).alias("weight_share"))


def episode_sweep(df: DataFrame, levels: Sequence[float], peak: str = "peak_v",
                  end: str = "end_v") -> DataFrame:
    """Plots with an episode, and how far they are cleared, at several episode thresholds."""
    gone = clip(1.0 - F.try_divide(F.col(end), F.col(peak)), 0.0, 1.0)
    rows = df.select(F.col(peak).alias("_p"), gone.alias("_g")).select("_p", "_g", F.explode(
        F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    has = F.col("_p") >= F.col("level")
    rows = rows.withColumn("_c", F.when(has, F.col("_g"))).withColumn("_has", has)
    head = rows.groupBy("level").agg(
        F.count_if("_has").alias("with_episode"), F.count_if(~F.col("_has")).alias("without"),
        F.avg(F.coalesce(F.col("_c") > 0.8, F.lit(False)).cast("double")).alias("over_08"),
        F.avg(F.coalesce(F.col("_c") < 0.2, F.lit(False)).cast("double")).alias("under_02"))
    return null_safe_join(head, quantiles(rows, ["level"], "_c", {"median_cleared": 0.5}), ["level"], "left")


def span_sweep(plots: DataFrame, spans: Sequence[float], shipped: float) -> DataFrame:
    """Totals and within-class spreads at several spans; span 0 is the null model.

    A forecast is reference x (1 + span x deviation), so totals are linear in the span and class
    quantiles scale with it: one pass over the plots serves every span.
    """
    f = centred_factor(plots, "x", ["cls"], 1.0).withColumn("dev", F.col("factor") - 1.0)
    rw = F.col("reference") * F.col("weight")
    sums = f.groupBy("cls").agg(F.sum(rw).alias("a"), F.sum(rw * F.col("dev")).alias("b"),
                                F.sum("weight").alias("w"), F.max("reference").alias("ref"))
    q = quantiles(f, ["cls"], "dev", {"d10": 0.1, "d90": 0.9})
    per = null_safe_join(sums, q, ["cls"]).select("*", F.explode(
        F.array(*[F.lit(float(s)) for s in spans])).alias("span"))
    s = F.col("span")
    out = per.groupBy("span").agg(
        F.sum(F.col("a") + s * F.col("b")).alias("total"), F.sum("w").alias("_w"),
        F.sum(F.col("a") + float(shipped) * F.col("b")).alias("_ship"),
        F.median(F.col("ref") * s * (F.col("d90") - F.col("d10"))).alias("median_spread"))
    return out.select("span", "total", (F.col("total") / F.col("_w")).alias("value_wt"),
                      (100.0 * (F.col("total") - F.col("_ship")) / F.col("_ship")).alias("vs_shipped_pct"),
                      "median_spread")


def class_forecast(plots: DataFrame, reference: Mapping[str, float], span: float) -> DataFrame:
    """Forecast from a class reference and the centred integral: reference x factor."""
    d = plots.withColumn("reference", lookup(F.col("cls"), reference, "reference"))
    d = centred_factor(d, "x", ["cls"], span)
    return d.withColumn("forecast", F.col("reference") * F.col("factor"))


def label_swap(plots: DataFrame, labels: DataFrame, reference: Mapping[str, float],
               span: float = 0.30) -> DataFrame:
    """The whole forecast under a second label set, class by class."""
    def totals(df: DataFrame) -> DataFrame:
        return class_forecast(df, reference, span).groupBy("cls").agg(
            F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"),
            F.sum(F.col("forecast") * F.col("weight")).alias("total"))

    ours = totals(plots)
    theirs = totals(swap_label(plots, labels, "plot_id", "cls"))
    r = theirs.select("cls", *[F.col(c).alias(f"{c}_swapped") for c in ("n", "weight", "total")])
    both = ours.join(r, "cls", "full").na.fill(0)
    return both.withColumn("diff", F.col("total_swapped") - F.col("total"))


def sources_of(plots: DataFrame, other: DataFrame, axis: str, prior: Sequence[float], labels: Sequence[str], reference: Mapping[str, float],
               sigma: DataFrame, noises: int = 1000, draws: int = 200, scenario: float = 0.10, span: float = 0.30) -> DataFrame:
    """What the total is worth: one forecast, repeated with one thing changed at a time.

    ``plots``: plot_id, cls, weight, x, cells, ``axis`` and ``allocated``; the allocated plots are those
    whose class comes from the ordered cut. ``other`` (plot_id, cls) is a second set of labels.
    Prior and tie order move allocated plots only; the others' part of the total is summed once. Their
    classes have to be others than ``labels``, so that no class is centred on both.
    """
    base = materialise(plots.withColumn("reference", lookup(F.col("cls"), reference, "reference")))
    if not base.where(~F.col("allocated") & F.col("cls").isin(list(labels))).isEmpty():
        raise ValueError("a plot outside the allocation has one of its labels")
    moving = base.where("allocated").select("plot_id", axis, "weight", "x")
    total = materialise(class_total(base, span).select("total"))
    rest = materialise(class_total(base.where(~F.col("allocated")), span).select(F.coalesce("total", F.lit(0.0)).alias("rest")))

    def whole(per_draw: DataFrame) -> DataFrame:
        return null_safe_join(per_draw.select("draw", "total"), rest, []).select("draw", (F.col("total") + F.col("rest")).alias("total"))

    swapped = swap_label(base, other, "plot_id", "cls").withColumn("reference", lookup(F.col("cls"), reference, "reference"))
    both = null_safe_join(total, class_total(swapped, span).select(F.col("total").alias("alt")), [])
    mix = whole(prior_draws(moving, axis, prior, labels, reference, sigma, draws, span))
    ties = whole(tie_totals(moving, axis, prior, labels, reference, draws, span))
    noise = noise_draws(base, noises, span)
    x = F.col("total")
    # Without allocated plots there is nothing to draw, and the total stands.
    def drawn(name: str, per_draw: DataFrame, low: Column, high: Column) -> DataFrame:
        row = null_safe_join(budget_row(name, per_draw, low, high), total, [])
        return row.select("source", F.coalesce("low", "total").alias("low"), F.coalesce("high", "total").alias("high"))

    rows = [
        budget_row("reference (stated scenario)", total, (1 - scenario) * F.max(x), (1 + scenario) * F.max(x)),
        budget_row("labelling", both, F.max(F.least("total", "alt")), F.max(F.greatest("total", "alt"))),
        drawn("allocation prior", mix, F.percentile(x, 0.05), F.percentile(x, 0.95)),
        drawn("tie order", ties, F.min(x), F.max(x)),
        drawn("speckle", noise, F.percentile(x, 0.05), F.percentile(x, 0.95))]
    return uncertainty_budget(total, rows)


def budget_row(source: str, df: DataFrame, low: Column, high: Column) -> DataFrame:
    return df.agg(low.alias("low"), high.alias("high")).select(
        F.lit(source).alias("source"), F.col("low").cast("double"), F.col("high").cast("double"))


def uncertainty_budget(total: DataFrame, rows: Sequence[DataFrame]) -> DataFrame:
    """Low, high and half-width per source, widest first."""
    t = null_safe_join(stack(*rows), total.select("total"), [])
    half = (F.col("high") - F.col("low")) / 2.0
    return t.withColumns({"half_width": half, "half_width_pct": 100.0 * half / F.col("total")}).orderBy(
        F.col("half_width").desc(), "source")
