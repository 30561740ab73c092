"""Resampling, sensitivity and clustering, bound to the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldspark.functions import rand
from fieldspark.functions.expr import lookup
from fieldspark.operators import cluster, draws, ordered, resample, rollup, series, stats
from fieldspark.plans import bindings as B
from fieldspark.plans.q_aggregates import log_ratios
from fieldspark.plans.q_series import (CUT_LABELS, CUT_PRIOR, PEAK, PRED, canopy_signal, cut_sql, factor_sql, preds)
from fieldspark.plans.q_stats import EDGES, spearman_sql
from fieldspark.sources.stage import materialise
from fieldspark.plans.registry import query

# Draws of the bootstrap, the two 999-fold tests, ties and priors, and noise.
DRAWS, FOLDS, TIES, NOISES = 2000, 999, 200, 1000


def mix32_sql(row_id: str, draw: str, seed: int) -> str:
    m = rand.MASK
    h = (f"((({row_id})::BIGINT & {m}) * {rand.ID_STEP} + ((({row_id})::BIGINT >> 32) & {m}) * {rand.HIGH_STEP} + "
         f"({draw}) * {rand.DRAW_STEP} + {seed}) & {m}")
    h = f"xor(({h}), ({h}) >> 16)"
    h = f"(({h}) * {rand.MULTIPLIER_1}) & {m}"
    h = f"xor(({h}), ({h}) >> 15)"
    h = f"(({h}) * {rand.MULTIPLIER_2}) & {m}"
    return f"xor(({h}), ({h}) >> 16)"


def mix_sql(row_id: str, draw: str, seed: int) -> str:
    return f"({mix32_sql(row_id, draw, seed)} * {1 << 20} + ({mix32_sql(row_id, draw, seed + rand.LANE_STEP)} >> 12))"


def uniform_sql(row_id: str, draw: str, seed: int) -> str:
    return f"(({mix_sql(row_id, draw, seed)} + 0.5::DOUBLE) / {float(1 << rand.BITS)!r}::DOUBLE)"


def normal_sql(row_id: str, draw: str, seed: int) -> str:
    return (f"(sqrt(-2.0 * ln({uniform_sql(row_id, draw, seed)})) * cos({2 * math.pi!r}::DOUBLE * "
            f"{uniform_sql(row_id, draw, seed + 7919)}))")


def poisson_sql(u: str) -> str:
    term, cdf, parts = math.exp(-1.0), 0.0, []
    for k in range(rand.POISSON_TERMS):
        cdf += term
        parts.append(f"({u} >= {cdf!r}::DOUBLE)::INTEGER")
        term /= k + 1
    return "(" + " + ".join(parts) + ")"


def drawn(src: str, n: int = DRAWS) -> str:
    return f"(SELECT s.*, d.draw FROM ({src}) s, (SELECT unnest(range({n})) AS draw) d)"


ERRORS = f"""SELECT plot_id, max(pred) FILTER (predictor = 'flat_hold') - truth AS em, max(pred) FILTER (predictor = 'persistence') - truth AS eb
FROM ({PRED}) p GROUP BY plot_id, truth"""


def errors(t):
    w = preds(t).groupBy("plot_id", "truth").agg(*[
        F.max(F.when(F.col("predictor") == n, F.col("pred"))).alias(n) for n in ("persistence", "flat_hold")])
    return w.select("plot_id", (F.col("flat_hold") - F.col("truth")).alias("e_model"),
                    (F.col("persistence") - F.col("truth")).alias("e_base"))


@query("bootstrap_skill", f"""SELECT quantile_cont(skill, 0.025) AS ci_lo, quantile_cont(skill, 0.975) AS ci_hi FROM (SELECT draw, 1 - sum(w * em * em) / sum(w * eb * eb) AS skill FROM
(SELECT *, {poisson_sql('u')} AS w FROM (SELECT *, {uniform_sql('plot_id', 'draw', 11)} AS u FROM {drawn(ERRORS)} e) a) b GROUP BY 1) c""", f="ci_lo ci_hi")
def _(t):
    return resample.bootstrap_skill(errors(t), DRAWS)


_BLOCK = f"SELECT plot_id, v, b, floor(x / 500)::BIGINT * 100000 + floor(y / 500)::BIGINT AS block FROM ({B.POINTS}) p"
_COPIES = f"""SELECT draw, v, b FROM (SELECT draw, v, b, unnest(range({poisson_sql('u')})) FROM (SELECT *, {uniform_sql('block', 'draw', 12)} AS u FROM {drawn(_BLOCK, FOLDS)} e) a) c"""


@query("block_bootstrap_rho", f"""SELECT (SELECT count(DISTINCT block) FROM ({_BLOCK}) k) AS blocks, (SELECT count(*) FROM ({_BLOCK}) k)::BIGINT AS n, (SELECT median(n) FROM (SELECT count(*) AS n FROM ({_BLOCK}) k GROUP BY block) m) AS median_block_n,
(SELECT rho FROM ({spearman_sql(_BLOCK, 'v', 'b')}) s) AS rho, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi FROM ({spearman_sql(_COPIES, 'v', 'b', 'draw')}) d""", f="median_block_n rho lo hi")
def _(t):
    return resample.block_bootstrap(B.points(t), "v", "b", draws=FOLDS)


def permuted_sql(placed: str, seed: int) -> str:
    """``placed(draw, c, n, x)`` with x, a place 0..n-1, replaced by the place it goes to."""
    for step in range(draws.ROUNDS):
        mirror = f"SELECT draw, c, n, x, ({mix32_sql(str(step), 'draw', seed)} % n + n - x) % n AS y FROM ({placed}) m{step}"
        bit = f"({mix32_sql('greatest(x, y)', 'draw', draws.round_seed(seed, step))} & 1)"
        placed = f"SELECT draw, c, n, CASE WHEN {bit} = 1 THEN y ELSE x END AS x FROM ({mirror}) s{step}"
    return placed


def perm_sql(centred: str) -> str:
    """(draw, plot_id, c): the centred values dealt again in every draw."""
    placed = f"SELECT plot_id, c, count(*) OVER () AS n, row_number() OVER (ORDER BY plot_id, c) - 1 AS x FROM ({centred}) p"
    moved = permuted_sql(f"SELECT draw, c, n, x FROM {drawn(placed, FOLDS)} d", 13)
    return f"SELECT s.draw, i.plot_id, s.c FROM ({moved}) s JOIN ({placed}) i USING (x)"


_PERM = perm_sql(f"SELECT plot_id, v - avg(v) OVER () AS c FROM ({B.POINTS}) p")
_SS = f"(SELECT var_pop(v) * count(*) FROM ({B.POINTS}) q)"


@query("permutation_morans", f"""SELECT observed, avg(i) AS null_mean, count(*) FILTER (i >= observed) AS exceed, count(*) AS draws, (1.0 + count(*) FILTER (i >= observed)) / (count(*) + 1.0) AS p,
CASE WHEN count(*) FILTER (i >= observed) = 0 THEN 'p<' ELSE 'p=' END || printf('%.3f', ((1.0 + count(*) FILTER (i >= observed)) / (count(*) + 1.0))::DOUBLE) AS shown FROM
(SELECT a.draw, sum(a.c * e.w * b.c) / {_SS} AS i FROM ({EDGES}) e JOIN ({_PERM}) a ON a.plot_id = e.plot_id JOIN ({_PERM}) b ON b.plot_id = e.donor_id AND b.draw = a.draw GROUP BY 1) n,
(SELECT sum(a.c * e.w * b.c) / {_SS} AS observed FROM ({EDGES}) e JOIN (SELECT plot_id, v - avg(v) OVER () AS c FROM ({B.POINTS}) p) a USING (plot_id) JOIN (SELECT plot_id, v - avg(v) OVER () AS c FROM ({B.POINTS}) p) b ON b.plot_id = e.donor_id) o GROUP BY observed""",
       f="observed null_mean p")
def _(t):
    p = B.points(t)
    return resample.permutation_morans(p, stats.neighbour_weights(p), draws=FOLDS, where=p.select("plot_id", "x", "y"))


TIED = f"SELECT *, round(value * 20) AS axis FROM ({B.PLOTS}) p"
_TIE = f"""SELECT draw, {cut_sql('share')} AS bucket, sum(weight) AS weight FROM (SELECT draw, weight, sum(weight) OVER (PARTITION BY draw ORDER BY axis, h, plot_id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY draw) AS share FROM
(SELECT *, {mix_sql('plot_id', 'draw', 14)} AS h FROM {drawn(TIED, TIES)} a) b) c GROUP BY 1, 2"""


def tied(t):
    return B.plots(t).withColumn("axis", F.round(F.col("value") * 20))


@query("tie_permutation", f"SELECT bucket, min(weight) AS weight_min, max(weight) AS weight_max, count(*) AS draws FROM ({_TIE}) t GROUP BY 1", f="weight_min weight_max")
def _(t):
    return resample.tie_spread(resample.tie_permutation(tied(t), "axis", "weight", CUT_PRIOR, CUT_LABELS, TIES))


REF = f"SELECT *, weight AS cells, value AS x, {B.sql_map(B.REFERENCE)} AS reference FROM ({B.PLOTS}) p"


def ref(t):
    return B.plots(t).withColumns({"cells": F.col("weight"), "x": F.col("value"),
                                   "reference": lookup(F.col("cls"), B.REFERENCE, "reference")})


_NOISE = f"""SELECT draw, sum(reference * factor * weight) AS total FROM ({factor_sql('x', f"SELECT * REPLACE (x + 4.34 / sqrt(greatest(cells, 1)) * {normal_sql('plot_id', 'draw', 15)} AS x) FROM {drawn(REF, NOISES)} a", 'draw, cls', '0.30')}) f GROUP BY 1"""
NOISE = f"SELECT quantile_cont(total, 0.05) AS low, quantile_cont(total, 0.95) AS high FROM ({_NOISE}) n"


@query("noise_draws", NOISE, f="low high", nd=4)
def _(t):
    return resample.over_draws(resample.noise_draws(ref(t), NOISES), "total", {"low": 0.05, "high": 0.95})


# The three ordered labels take the references of three classes.
LABEL_REF = {"Bajra": 1.25, "Maize": 1.75, "Groundnut": 2.5}
_SHARE = f"SELECT plot_id, weight, value AS x, sum(weight) OVER (ORDER BY axis, plot_id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER () AS share FROM ({TIED}) p"
_SIGMA = f"(SELECT stddev_samp(ln(share / CASE cls WHEN 'PROMO' THEN 0.2 ELSE 0.16 END)) FROM (SELECT cls, sum(weight) / (SELECT sum(p_size) FROM part) AS share FROM ({B.PLOTS}) p GROUP BY 1) q WHERE cls IN ('PROMO', 'ECONOMY'))"
_W = [f"{w}::DOUBLE * exp({_SIGMA} * {normal_sql(str(i + 1), 'draw', 16)})" for i, w in enumerate(CUT_PRIOR)]
_PRIOR = f"""SELECT draw, plot_id, weight, x, CASE WHEN share <= w1 / (w1 + w2 + w3) THEN 'Bajra' WHEN share <= w1 / (w1 + w2 + w3) + w2 / (w1 + w2 + w3) THEN 'Maize' ELSE 'Groundnut' END AS cls FROM ({_SHARE}) s,
(SELECT draw, {_W[0]} AS w1, {_W[1]} AS w2, {_W[2]} AS w3 FROM (SELECT unnest(range({TIES})) AS draw) d) w"""
_MIX = f"""SELECT draw, sum({B.sql_map(LABEL_REF)} * factor * weight) AS total, """ + ", ".join(
    f"coalesce(sum(weight) FILTER (cls = '{c}'), 0) AS weight_{c}" for c in CUT_LABELS) + f" FROM ({factor_sql('x', _PRIOR, 'draw, cls', '0.30')}) f GROUP BY 1"


@query("prior_perturbation", _MIX, f="total weight_Bajra weight_Maize weight_Groundnut", nd=4, cast="draw:INTEGER")
def _(t):
    p = tied(t).withColumn("x", F.col("value"))
    return resample.prior_draws(p, "axis", CUT_PRIOR, CUT_LABELS, LABEL_REF, rollup.prior_sigma(log_ratios(t)), TIES)


@query("threshold_sweep", f"""SELECT level, count(*) FILTER (value >= level AND confidence = 'high') AS n, coalesce(sum(weight) FILTER (value >= level AND confidence = 'high'), 0) AS weight,
coalesce(sum(weight) FILTER (value >= level AND confidence = 'high'), 0) / sum(weight) AS weight_share FROM ({B.PLOTS}) p, (VALUES (0.95::DOUBLE), (1.0), (1.05)) l(level) GROUP BY 1""", f="level weight weight_share")
def _(t):
    return resample.threshold_sweep(B.plots(t), "value", (0.95, 1.0, 1.05), F.col("confidence") == "high")


@query("episode_sweep", f"""SELECT level, count(*) FILTER (peak_v >= level) AS with_episode, count(*) FILTER (peak_v < level) AS without, avg(coalesce((c > 0.8)::INTEGER, 0)) AS over_08, avg(coalesce((c < 0.2)::INTEGER, 0)) AS under_02, median(c) AS median_cleared FROM
(SELECT *, CASE WHEN peak_v >= level THEN greatest(0, least(1, 1 - end_v / nullif(peak_v, 0))) END AS c FROM ({PEAK}) p, (VALUES (0.25::DOUBLE), (0.5), (1.0)) l(level) WHERE peak_v IS NOT NULL) q GROUP BY 1""", f="level over_08 under_02 median_cleared")
def _(t):
    return resample.episode_sweep(series.peak(canopy_signal(t)).where("peak_v is not null"), (0.25, 0.5, 1.0))


SPANS = (0.0, 0.15, 0.20, 0.30, 0.45)
_DEV = factor_sql("x", REF, "cls, span", "span").replace(f"FROM ({REF}) s", f"FROM ({REF}) s, (SELECT unnest([{', '.join(map(str, SPANS))}]::DOUBLE[]) AS span) z")
_SPAN = f"""SELECT span, sum(reference * factor * weight) AS total, sum(reference * factor * weight) / sum(weight) AS value_wt FROM ({_DEV}) d GROUP BY 1"""
SPAN = f"""SELECT s.*, 100 * (total - (SELECT total FROM ({_SPAN}) q WHERE abs(span - 0.3) < 1e-9)) / (SELECT total FROM ({_SPAN}) q WHERE abs(span - 0.3) < 1e-9) AS vs_shipped_pct, m.median_spread FROM ({_SPAN}) s JOIN
(SELECT span, median(w) AS median_spread FROM (SELECT span, cls, quantile_cont(reference * factor, 0.9) - quantile_cont(reference * factor, 0.1) AS w FROM ({_DEV}) d GROUP BY 1, 2) k GROUP BY 1) m USING (span)"""


@query("span_sweep", SPAN, f="span total value_wt vs_shipped_pct median_spread", nd=4)
def _(t):
    return resample.span_sweep(ref(t), SPANS, 0.30)


SWAPPED = f"SELECT * REPLACE (CASE WHEN weight < 40 THEN cls ELSE 'PROMO' END AS cls) FROM ({B.PLOTS}) p"


def _totals(src: str) -> str:
    body = factor_sql("value", src, "cls", "0.30")
    return f"SELECT cls, count(*) AS n, sum(weight) AS weight, sum({B.sql_map(B.REFERENCE)} * factor * weight) AS total FROM ({body}) f GROUP BY 1"


@query("label_swap", f"""SELECT cls, coalesce(a.n, 0) AS n, coalesce(a.weight, 0) AS weight, coalesce(a.total, 0) AS total, coalesce(b.n, 0) AS n_swapped, coalesce(b.weight, 0) AS weight_swapped, coalesce(b.total, 0) AS total_swapped,
coalesce(b.total, 0) - coalesce(a.total, 0) AS diff FROM ({_totals(B.PLOTS)}) a FULL JOIN ({_totals(SWAPPED)}) b USING (cls)""", f="weight total weight_swapped total_swapped diff", nd=4)
def _(t):
    return label_swap(t)


def swapped_labels(t):
    return B.plots(t).select("plot_id", F.when(F.col("weight") < 40, F.col("cls")).otherwise("PROMO").alias("cls"))


def label_swap(t):
    p = B.plots(t).withColumn("x", F.col("value"))
    return resample.label_swap(p, swapped_labels(t), B.REFERENCE)


# Two classes come from rules; the plots of the others are allocated to the three ordered labels.
MEASURED = ("PROMO", "ECONOMY")
ALL_REF = {**B.REFERENCE, **LABEL_REF}
_SPLIT = f"SELECT plot_id, cls AS first, weight, value AS x, axis, cls NOT IN {MEASURED} AS allocated FROM ({TIED}) p"


def _cut(order: str, by: str, src: str) -> str:
    """Every row of ``src`` with its share of the allocated plots in ``order``."""
    part = ", ".join(c for c in ("allocated", by) if c)
    return f"SELECT *, sum(weight) OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY {part}) AS share FROM ({src}) s"


def _sum(src: str, by: str = "") -> str:
    """Total of the forecast of ``src``, per ``by``."""
    keys = f"{by}, cls" if by else "cls"
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {head}sum({B.sql_map(ALL_REF)} * factor * weight) AS total FROM ({factor_sql('x', src, keys, '0.30')}) f{tail}"


_BASE = f"SELECT plot_id, weight, x, weight AS cells, axis, allocated, share, CASE WHEN allocated THEN {cut_sql('share')} ELSE first END AS cls FROM ({_cut('axis, plot_id', '', _SPLIT)}) c"
_OTHER = f"SELECT * REPLACE (CASE WHEN weight < 40 THEN cls ELSE 'PROMO' END AS cls) FROM ({_BASE}) b"
_MOVED = f"""SELECT draw, weight, x, CASE WHEN NOT allocated THEN cls WHEN share <= w1 / (w1 + w2 + w3) THEN 'Bajra' WHEN share <= w1 / (w1 + w2 + w3) + w2 / (w1 + w2 + w3) THEN 'Maize' ELSE 'Groundnut' END AS cls FROM ({_BASE}) s,
(SELECT draw, {_W[0]} AS w1, {_W[1]} AS w2, {_W[2]} AS w3 FROM (SELECT unnest(range({TIES})) AS draw) d) w"""
_TIED = f"SELECT draw, weight, x, CASE WHEN allocated THEN {cut_sql('share')} ELSE first END AS cls FROM ({_cut('axis, h, plot_id', 'draw', f'SELECT *, {mix_sql("plot_id", "draw", 14)} AS h FROM {drawn(_SPLIT, TIES)} a')}) c"
_LOUD = f"SELECT * REPLACE (x + 4.34 / sqrt(greatest(cells, 1)) * {normal_sql('plot_id', 'draw', 15)} AS x) FROM {drawn(_BASE, NOISES)} a"
BUDGET = f"""WITH b AS (SELECT total FROM ({_sum(_BASE)}) z) SELECT source, low, high, total, (high - low) / 2 AS half_width, 50 * (high - low) / total AS half_width_pct FROM b, (
SELECT 'reference (stated scenario)' AS source, 0.9 * total AS low, 1.1 * total AS high FROM b
UNION ALL SELECT 'labelling', least(b.total, o.total), greatest(b.total, o.total) FROM b, ({_sum(_OTHER)}) o
UNION ALL SELECT 'allocation prior', quantile_cont(total, 0.05), quantile_cont(total, 0.95) FROM ({_sum(_MOVED, 'draw')}) m
UNION ALL SELECT 'tie order', min(total), max(total) FROM ({_sum(_TIED, 'draw')}) u
UNION ALL SELECT 'speckle', quantile_cont(total, 0.05), quantile_cont(total, 0.95) FROM ({_sum(_LOUD, 'draw')}) n) r"""


@query("uncertainty_budget", BUDGET, f="low high total half_width half_width_pct", nd=4)
def _(t):
    return uncertainty_budget(t)


def budget_plots(t):
    """Plots with the class that rules or the allocation give them."""
    p = tied(t).withColumns({"x": F.col("value"), "cells": F.col("weight"), "allocated": ~F.col("cls").isin(*MEASURED)})
    cut = ordered.share_cut(p.where("allocated"), "axis", "plot_id", "weight", CUT_PRIOR, CUT_LABELS)
    columns = ["plot_id", "weight", "x", "cells", "axis", "allocated"]
    return p.where(~F.col("allocated")).select("cls", *columns).unionByName(cut.select(F.col("bucket").alias("cls"), *columns))


def uncertainty_budget(t):
    plots = materialise(budget_plots(t))
    other = plots.select("plot_id", F.when(F.col("weight") < 40, F.col("cls")).otherwise("PROMO").alias("cls"))
    return resample.sources_of(plots, other, "axis", CUT_PRIOR, CUT_LABELS, ALL_REF, rollup.prior_sigma(log_ratios(t)), NOISES, TIES)


@query("rank_sensitivity", f"""SELECT scenario, total, half_width, row_number() OVER (ORDER BY half_width DESC, scenario) AS place FROM (SELECT *, abs(total - max(total) FILTER (scenario = 'all') OVER ()) AS half_width
FROM (SELECT scenario, sum(value * weight) AS total FROM (SELECT *, unnest([cls, 'all']) AS scenario FROM ({B.PLOTS}) p) q GROUP BY 1) s) w""", f="total half_width", nd=4, cast="place:INTEGER")
def _(t):
    s = rollup.with_total(B.plots(t)).replace("ALL", "all", ["cls"]).groupBy(F.col("cls").alias("scenario")).agg(
        F.sum(F.col("value") * F.col("weight")).alias("total"))
    return rollup.rank_sensitivity(s, "scenario", "all")


# -- clustering -------------------------------------------------------------------------------
def _argmax(r: int) -> str:
    a, b, c = (f"e{3 * r + i}" for i in range(3))
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


RUNS = " UNION ALL ".join(f"SELECT {r} AS run, plot_id, {_argmax(r)} AS cluster FROM ({B.VECTORS}) v" for r in range(3))


def runs(t):
    """Three labelings of the vectors, each by the largest of three elements."""
    v = B.vectors(t)
    rows = []
    for r in range(3):
        a, b, c = (F.col(f"e{3 * r + i}") for i in range(3))
        rows.append(F.struct(F.lit(r).alias("run"), F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2).alias("cluster")))
    return v.select("plot_id", F.explode(F.array(*rows)).alias("_s")).select("plot_id", "_s.*")


_CONT = f"SELECT a.run AS ra, b.run AS rb, a.cluster AS ca, b.cluster AS cb, count(*) AS n FROM ({RUNS}) a JOIN ({RUNS}) b USING (plot_id) GROUP BY 1, 2, 3, 4"
_BEST = f"(SELECT arg_min(ra, (-s, ra)) FROM (SELECT ra, sum(n * n) AS s FROM ({_CONT}) c GROUP BY 1) d)"


@query("consensus_partition", f"""SELECT a.plot_id, a.run, a.cluster, sum(c.n) / (3.0 * max(z.size)) AS stability FROM ({RUNS}) a JOIN ({RUNS}) b USING (plot_id) JOIN ({_CONT}) c ON c.ra = a.run AND c.rb = b.run AND c.ca = a.cluster AND c.cb = b.cluster
JOIN (SELECT run, cluster, count(*) AS size FROM ({RUNS}) r GROUP BY 1, 2) z ON z.run = a.run AND z.cluster = a.cluster WHERE a.run = {_BEST} GROUP BY 1, 2, 3""", f="stability")
def _(t):
    return cluster.consensus_partition(runs(t))


_CLS = f"SELECT *, CASE cluster % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS cls FROM ({B.VECTORS}) v"
_CEN = "SELECT cluster AS k, max(cls) AS kc, " + ", ".join(f"avg(e{i}) AS m{i}" for i in range(B.ELEMENTS)) + f" FROM ({_CLS}) c GROUP BY 1"


@query("cluster_margin", f"""SELECT plot_id, own, other AS nearest_other, (other - own) / (other + own) AS margin FROM (SELECT plot_id, min(d) FILTER (k = cluster) AS own, min(d) FILTER (kc <> cls) AS other FROM
(SELECT plot_id, cluster, cls, k, kc, sqrt({' + '.join(f'(e{i} - m{i}) ** 2' for i in range(B.ELEMENTS))}) AS d FROM ({_CLS}) v, ({_CEN}) m) x GROUP BY 1) y""", f="own nearest_other margin")
def _(t):
    k = F.col("cluster") % 3
    v = B.vectors(t).withColumn("cls", F.when(k == 0, "A").when(k == 1, "B").otherwise("C"))
    return cluster.cluster_margin(v, B.DIMS)


def kmeans(t, k: int, seeds=range(20)):
    return cluster.kmeans_runs(rollup.zscore(B.vectors(t), B.DIMS).select("plot_id", *B.DIMS), B.DIMS, k, list(seeds))


@query("kmeans_seeds")
def _(t):
    """20 seeds of 10 starts each."""
    return kmeans(t, 9).groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("silhouette")
def _(t):
    return cluster.silhouette(B.vectors(t), B.DIMS)
