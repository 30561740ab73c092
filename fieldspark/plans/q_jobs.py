"""End-to-end jobs, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import series
from fieldspark.operators.ordered import null_safe_join
from fieldspark.plans import bindings as B
from fieldspark.plans import jobs
from fieldspark.plans.q_aggregates import REF_PLOTS, class_years, order_days, ref_plots
from fieldspark.plans.q_resample import DRAWS, FOLDS, RUNS, drawn, perm_sql, poisson_sql, runs, uniform_sql
from fieldspark.plans.q_scans import DRIFT, catalogue, drift
from fieldspark.plans.q_series import (CLOSE, CUT_LABELS, CUT_PRIOR, HORIZON, PRED, SCORES, canopy, cut_sql,
                                       factor_sql, horizon, preds)
from fieldspark.plans.q_stats import EDGES, normal_tail_sql, rank_sql, spearman_sql
from fieldspark.plans.registry import query

# -- features: users as plots, purchases as cells ---------------------------------------------
# Every user is a plot, and so are as many numbers beyond them; the latter have no cell.
PLACES = "SELECT user_id + k * 100000 AS plot_id, (user_id * 37 % 101)::DOUBLE + k / 2.0 AS x, (user_id * 53 % 97)::DOUBLE AS y, k FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(2)) AS k) s WHERE k = 0 OR user_id % 10 = 0"
USER_CELLS = f"""SELECT user_id AS plot_id, {B.SLOT} AS pass, value / 0.997::DOUBLE AS value FROM events WHERE event_type = 'purchase'"""


def user_cells(t):
    return t.events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("plot_id"), B.slot().alias("pass"), (F.col("value") / B.UNTIE).alias("value"))


def places(t):
    """Plots (plot_id, x, y, k) of the cells; those with k = 1 have none."""
    u = F.col("user_id")
    k = F.explode(F.when(u % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")
    return t.events.select("user_id").distinct().select("user_id", k).select(
        (u + F.col("k") * 100000).alias("plot_id"), ((u * 37 % 101).cast("double") + F.col("k") / 2.0).alias("x"),
        (u * 53 % 97).cast("double").alias("y"), "k")


_Z = f"""SELECT f.plot_id, f.pass, f.doy, z.v, z.n, k.core FROM (SELECT plot_id, pass, (pass * 5 + 3)::DOUBLE AS doy FROM ({PLACES}) p, (SELECT unnest(range(6)) AS pass) s) f
LEFT JOIN (SELECT plot_id, pass, 10 * log10(avg(value)) + CASE WHEN pass = 5 THEN 0.5 ELSE 0 END AS v, count(*) AS n FROM ({USER_CELLS}) c WHERE value > 0 GROUP BY 1, 2) z USING (plot_id, pass)
JOIN (SELECT plot_id, 3 + plot_id % 3 AS core FROM ({PLACES}) c) k USING (plot_id)"""
_USABLE = f"SELECT plot_id, pass, doy, CASE WHEN n / core::DOUBLE >= 0.5 THEN v END AS v FROM ({_Z}) z"
_FILL = f"""SELECT plot_id, pass, n AS n_valid, CASE WHEN n = 6 THEN 'measured' WHEN n >= 4 THEN 'interpolated' ELSE 'imputed' END AS data_quality,
coalesce(v, CASE WHEN n >= 4 THEN CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (doy - pd) / (nd - pd) END END) AS v FROM
(SELECT *, count(v) OVER (PARTITION BY plot_id) AS n, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN doy END IGNORE NULLS) OVER b AS pd,
first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN doy END IGNORE NULLS) OVER a AS nd FROM ({_USABLE}) f
WINDOW b AS (PARTITION BY plot_id ORDER BY doy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY plot_id ORDER BY doy ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) w"""
_NEAR = f"""SELECT * FROM (SELECT a.plot_id AS q, b.plot_id AS d, row_number() OVER (PARTITION BY a.plot_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.plot_id) AS nn FROM
(SELECT * FROM ({PLACES}) p WHERE plot_id IN (SELECT plot_id FROM ({_FILL}) f WHERE data_quality = 'imputed')) a JOIN (SELECT * FROM ({PLACES}) p WHERE plot_id IN (SELECT plot_id FROM ({_FILL}) f WHERE data_quality <> 'imputed')) b ON true) n WHERE nn <= 8"""
_DONE = f"""SELECT f.plot_id, f.pass, n_valid, data_quality, CASE WHEN data_quality = 'imputed' THEN i.v ELSE f.v END AS v FROM ({_FILL}) f LEFT JOIN
(SELECT q AS plot_id, pass, median(v) AS v FROM ({_NEAR}) n JOIN ({_FILL}) f ON f.plot_id = n.d GROUP BY 1, 2) i USING (plot_id, pass)"""
FEATURES = f"""SELECT plot_id, pass, n_valid, data_quality, CASE WHEN pass = 4 THEN (a + b) / 2 ELSE v END AS v, m - (a + b) / 2 AS anomaly FROM
(SELECT *, max(v) FILTER (pass = 3) OVER (PARTITION BY plot_id) AS a, max(v) FILTER (pass = 4) OVER (PARTITION BY plot_id) AS m, max(v) FILTER (pass = 5) OVER (PARTITION BY plot_id) AS b FROM ({_DONE}) d) e"""


def features(t):
    cells = user_cells(t)
    plots = places(t).select("plot_id", "x", "y", (3 + F.col("plot_id") % 3).alias("core_cells"))
    offsets = cells.select("pass").distinct().where("pass = 5").withColumn("offset", F.lit(0.5))
    return jobs.job_features(cells, plots, {i: d for i, d in B.DOYS.items()}, offsets, line=(3, 4, 5))


@query("job_features", FEATURES, f="v anomaly", cast="pass:INTEGER")
def _(t):
    return features(t).select("plot_id", "pass", "n_valid", "data_quality", "v", "anomaly")


# -- phenology --------------------------------------------------------------------------------
_PDEP = f"""SELECT plot_id, pass, doy, (v - (avg(v - drift_db) FILTER (pass IN (0, 1)) OVER (PARTITION BY plot_id) + drift_db)) AS departure
FROM ({B.OBS}) o JOIN ({DRIFT}) d USING (pass)"""
PHENOLOGY = f"""SELECT plot_id, greatest(0, d2, d3, d5) AS peak_v, greatest(d5, 0) AS end_v, greatest(0, d2, d3, d5) >= 0.5 AS has_canopy,
CASE WHEN greatest(0, d2, d3, d5) >= 0.5 THEN CASE WHEN d2 >= greatest(d3, d5) THEN 13.0 WHEN d3 >= d5 THEN 18.0 ELSE 28.0 END END AS peak_doy,
CASE WHEN greatest(0, d2, d3, d5) >= 0.5 THEN greatest(0, least(1, 1 - greatest(d5, 0) / greatest(0, d2, d3, d5))) END AS cleared_fraction,
(greatest(d5, 0) - greatest(d3, 0)) / 10 AS late_slope, ((d2 + d3) / 2 * 5 + (d3 + d5) / 2 * 10) / 15 AS integral, d0 AS departure_0, d1 AS departure_1, d2 AS departure_2, d3 AS departure_3, d5 AS departure_5
FROM (SELECT plot_id, """ + ", ".join(f"max(departure) FILTER (pass = {i}) AS d{i}" for i in (0, 1, 2, 3, 5)) + f""" FROM ({_PDEP}) p GROUP BY 1) w
WHERE d2 IS NOT NULL AND d3 IS NOT NULL AND d5 IS NOT NULL"""


def complete(t):
    return series.complete_on(B.obs(t), 6)


_FULL6 = f"SELECT plot_id FROM ({B.OBS}) o GROUP BY 1 HAVING count(v) = 6"


@query("job_phenology", f"SELECT * FROM ({PHENOLOGY}) p WHERE plot_id IN ({_FULL6})",
       f="peak_v end_v cleared_fraction late_slope integral departure_0 departure_1 departure_2 departure_3 departure_5", cast="peak_doy:DOUBLE")
def _(t):
    return jobs.job_phenology(complete(t), drift(t), (0, 1), (2, 3, 5))


# -- labels -----------------------------------------------------------------------------------
def label_frame(t):
    v = B.vectors(t).select("plot_id", *B.DIMS)
    p = B.points(t).select("plot_id", "x", "y", "weight", F.col("b").alias("canopy_end"))
    return v.join(p, "plot_id").withColumn("screened", F.col("e8") > 0.25)


_LF = f"SELECT v.*, p.x, p.y, p.weight, p.b AS canopy_end, v.e8 > 0.25 AS screened FROM ({B.VECTORS}) v JOIN ({B.POINTS}) p USING (plot_id)"
_LR = f"SELECT r.* FROM ({RUNS}) r JOIN ({_LF}) f USING (plot_id) WHERE NOT screened"
_LC = f"SELECT a.run AS ra, b.run AS rb, a.cluster AS ca, b.cluster AS cb, count(*) AS n FROM ({_LR}) a JOIN ({_LR}) b USING (plot_id) GROUP BY 1, 2, 3, 4"
_LP = f"SELECT plot_id, cluster FROM ({_LR}) r WHERE run = (SELECT arg_min(ra, (-s, ra)) FROM (SELECT ra, sum(n * n) AS s FROM ({_LC}) c GROUP BY 1) d)"
_LN = f"""SELECT * FROM (SELECT a.plot_id, p.cluster, row_number() OVER (PARTITION BY a.plot_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.plot_id) AS nn
FROM (SELECT * FROM ({_LF}) f WHERE screened) a JOIN (SELECT * FROM ({_LF}) f WHERE NOT screened) b ON true JOIN ({_LP}) p ON p.plot_id = b.plot_id) n WHERE nn <= 8"""
_LG = f"""SELECT plot_id, cluster FROM ({_LP}) p UNION ALL SELECT plot_id, arg_min(cluster, (-n, cluster)) FROM (SELECT plot_id, cluster, count(*) AS n FROM ({_LN}) x GROUP BY 1, 2) v GROUP BY 1"""
_LM = f"SELECT p.cluster, avg(e2) AS e2, avg(e4) AS e4 FROM ({_LF}) f JOIN ({_LP}) p USING (plot_id) GROUP BY 1"
_LZ = f"SELECT cluster, (e2 - avg(e2) OVER ()) / stddev_pop(e2) OVER () AS z2, (e4 - avg(e4) OVER ()) / stddev_pop(e4) OVER () AS z4 FROM ({_LM}) m"
_LT = f"""SELECT f.plot_id, f.weight, f.screened, f.e7, coalesce(CASE WHEN z2 >= 1 AND z4 <= 0 THEN 'Rice' WHEN z4 >= 1 THEN 'Cotton' END, CASE WHEN NOT f.screened AND f.canopy_end >= 0.15 THEN 'Cotton' END) AS cls
FROM ({_LF}) f JOIN ({_LG}) g USING (plot_id) JOIN ({_LZ}) z ON z.cluster = g.cluster"""
_LX = f"SELECT plot_id, weight, screened, cls, false AS tier2 FROM ({_LT}) t WHERE cls IS NOT NULL UNION ALL SELECT plot_id, weight, screened, {cut_sql('share')}, true FROM (SELECT *, sum(weight) OVER (ORDER BY e7, plot_id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER () AS share FROM ({_LT}) t WHERE cls IS NULL) s"
_LS = f"SELECT plot_id, screened, " + ", ".join(f"(e{i} - avg(e{i}) FILTER (NOT screened) OVER ()) / coalesce(nullif(stddev_pop(e{i}) FILTER (NOT screened) OVER (), 0), 1) AS e{i}" for i in range(B.ELEMENTS)) + f" FROM ({_LF}) f"
_LK = f"SELECT cluster, arg_min(cls, (-n, cls)) AS k FROM (SELECT cluster, cls, count(*) AS n FROM lx JOIN lg USING (plot_id) GROUP BY 1, 2) v GROUP BY 1"
_LD = f"SELECT s.plot_id, s.cls, g.cluster, c.cluster AS other, k.k, own.k AS own_k, sqrt({' + '.join(f'(z.e{i} - c.m{i}) ** 2' for i in range(B.ELEMENTS))}) AS d FROM lx s JOIN lg g USING (plot_id) JOIN ls z USING (plot_id) JOIN lk own ON own.cluster = g.cluster, lc c JOIN lk k ON k.cluster = c.cluster"
LABELS = f"""WITH lg AS MATERIALIZED ({_LG}), lx AS MATERIALIZED ({_LX}), ls AS MATERIALIZED ({_LS}), lk AS ({_LK}),
lc AS (SELECT cluster, {', '.join(f'avg(e{i}) AS m{i}' for i in range(B.ELEMENTS))} FROM ls JOIN lg USING (plot_id) WHERE NOT screened GROUP BY 1), ld AS ({_LD}),
lm AS (SELECT plot_id, min(d) FILTER (other = cluster) AS own, min(d) FILTER (k <> own_k) AS near FROM ld GROUP BY 1)
SELECT cls, CASE WHEN tier2 OR screened THEN 'low' ELSE 'high' END AS confidence, tier2, count(*) AS n, sum(weight) AS weight, avg((near - own) / (near + own)) AS margin FROM lx JOIN lm USING (plot_id) GROUP BY 1, 2, 3"""


@query("job_labels", LABELS, f="weight margin")
def _(t):
    f = label_frame(t)
    kept = runs(t).join(f.where(~F.col("screened")).select("plot_id"), "plot_id", "left_semi")
    out = jobs.job_labels(f, B.DIMS, "e7", CUT_PRIOR, CUT_LABELS, runs=kept, level="e2", drop="e4",
                          end="canopy_end", end_min=0.15)
    return out.groupBy("cls", "confidence", "tier2").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.avg("margin").alias("margin"))


@query("label_stability")
def _(t):
    """Crop labels at (9, 5), (9, 40), (7, 20) and (11, 20) against those at (9, 20), 10 starts a seed."""
    return jobs.label_stability(label_frame(t), B.DIMS, "e7", CUT_PRIOR, CUT_LABELS, level="e2", drop="e4", end="canopy_end", end_min=0.15)


# -- forecast ---------------------------------------------------------------------------------
WIDE_BANDS = {k: (0.3, 9.0) for k in B.CLASSES}
FORECAST = f"""SELECT plot_id, cls, season_integral, extrapolated_fraction, factor, {B.sql_map(B.REFERENCE)} AS reference, {B.sql_map(B.REFERENCE)} * factor AS value
FROM ({factor_sql('season_integral', f"SELECT * FROM ({CLOSE}) c WHERE season_integral IS NOT NULL", 'cls', '0.30')}) f"""


def forecast(t):
    full = series.complete_on(canopy(t).where("departure is not null"), 3)
    return jobs.job_forecast(full, B.plots(t), B.CALENDAR, B.REFERENCE, WIDE_BANDS)


@query("job_forecast", FORECAST, f="season_integral extrapolated_fraction factor reference value")
def _(t):
    return forecast(t).select("plot_id", "cls", "season_integral", "extrapolated_fraction", "factor", "reference", "value")


# -- shipping ---------------------------------------------------------------------------------
_SHIPPED = f"SELECT * REPLACE (round(value, 4) AS value, round(value * weight, 4) AS production) FROM ({REF_PLOTS}) r"
SHIP = f"""SELECT coalesce(cls, 'ALL') AS cls, count(*) AS n, sum(weight) AS weight, sum(production) AS production, sum(value * weight) / sum(weight) AS value_wt,
quantile_cont(value, 0.1) AS value_p10, quantile_cont(value, 0.9) AS value_p90 FROM ({_SHIPPED}) p GROUP BY ROLLUP(cls)"""


@query("job_ship", SHIP, f="weight production value_wt value_p10 value_p90")
def _(t):
    p = ref_plots(t).withColumns({"x": F.col("weight") * 100, "y": F.col("fraction") * 1000, "data_quality": F.lit("measured")})
    out = jobs.job_ship(p, ["plot_id", "cls", "weight", "value", "fraction", "production"], WIDE_BANDS, B.CLASSES)
    return out["summary"].select("cls", "n", "weight", "production", "value_wt", "value_p10", "value_p90")


# -- back-test --------------------------------------------------------------------------------
_OKP = f"SELECT * FROM ({PRED}) p WHERE plot_id NOT IN (SELECT plot_id FROM ({PRED}) q WHERE pred IS NULL OR truth IS NULL)"
_OKH = f"SELECT * FROM ({HORIZON}) p WHERE (plot_id, split) NOT IN (SELECT (plot_id, split) FROM ({HORIZON}) q WHERE pred IS NULL OR truth IS NULL)"
_ERR = f"SELECT plot_id, predictor, pred - truth AS em, max(pred - truth) FILTER (predictor = 'persistence') OVER (PARTITION BY plot_id) AS eb FROM ({_OKP}) p"
_CI = f"""SELECT predictor, quantile_cont(skill, 0.025) AS ci_lo, quantile_cont(skill, 0.975) AS ci_hi FROM (SELECT predictor, draw, 1 - sum(w * em * em) / sum(w * eb * eb) AS skill FROM
(SELECT *, {poisson_sql('u')} AS w FROM (SELECT *, {uniform_sql('plot_id', 'draw', 11)} AS u FROM {drawn(_ERR)} e) a) b GROUP BY 1, 2) c GROUP BY 1"""
_BEST = f"""SELECT cls, max(n) AS n, max(rmse) FILTER (predictor = 'flat_hold') AS rmse, max(skill) FILTER (predictor = 'flat_hold') AS skill, arg_min(predictor, (rmse, ord)) AS best FROM
({SCORES.format(by="cls,", part="PARTITION BY cls", src=_OKP)}) s JOIN (SELECT DISTINCT predictor, ord FROM ({PRED}) p) o USING (predictor) WHERE n >= 20 GROUP BY 1"""
BACKTEST = f"""SELECT 'all' AS part, 'all' AS item, predictor, n, rmse, skill, ci_lo, ci_hi FROM ({SCORES.format(by="", part="", src=_OKP)}) a JOIN ({_CI}) c USING (predictor)
UNION ALL SELECT 'class', cls, best, n, rmse, skill, NULL, NULL FROM ({_BEST}) b
UNION ALL SELECT 'horizon', split, predictor, n, rmse, skill, NULL, NULL FROM ({SCORES.format(by="split,", part="PARTITION BY split", src=_OKH)}) h"""


@query("job_backtest", BACKTEST, f="rmse skill ci_lo ci_hi")
def _(t):
    return jobs.job_backtest(preds(t), horizon(t), draws=DRAWS)


# -- validation -------------------------------------------------------------------------------
VFRAME = f"""SELECT plot_id, label::VARCHAR AS cls, v AS value, b AS reserved, fraction AS anomaly, (x + y) - 180 * floor((x + y) / 180) AS azimuth, weight / 3 AS elongation,
x / 5000 AS early, y / 5000 AS late, label < 3 AS flagged, abs(x) / 1000 AS cleared FROM ({B.POINTS}) p"""


def validation_frame(t):
    p = B.points(t)
    return p.select("plot_id", F.col("label").cast("string").alias("cls"), F.col("v").alias("value"), F.col("b").alias("reserved"),
                    F.col("fraction").alias("anomaly"), F.pmod(F.col("x") + F.col("y"), F.lit(180.0)).alias("azimuth"),
                    (F.col("weight") / 3).alias("elongation"), (F.col("x") / 5000).alias("early"), (F.col("y") / 5000).alias("late"),
                    (F.col("label") < 3).alias("flagged"), (F.abs("x") / 1000).alias("cleared"))


_RES = f"SELECT plot_id, value - avg(value) OVER (PARTITION BY cls) AS v FROM ({VFRAME}) f"
_TOP = f"SELECT arg_max(cls, (m, cls)) AS winner, max(m) AS m FROM (SELECT cls, median(reserved) AS m FROM ({VFRAME}) f GROUP BY 1) q"
_U = f"""SELECT n1, (u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM (SELECT n1::DOUBLE AS n1, n2::DOUBLE AS n2, r1 - n1 * (n1 + 1) / 2.0 AS u, ties FROM
(SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(rk) FILTER (g) AS r1, sum(k * k - 1.0) AS ties FROM (SELECT {{g}} AS g, {rank_sql('{v}')} AS rk,
count(*) OVER (PARTITION BY {{v}}) AS k FROM ({VFRAME}) f) r) s) t"""
NAMED, LOOK = "4", 318.4


def _greater(g: str, v: str) -> str:
    return f"(SELECT {normal_tail_sql('z')} AS p, n1 FROM ({_U.format(g=g, v=v)}) m)"


_LOOK = f"SELECT abs(((azimuth - 318.4 + 90) - 180 * floor((azimuth - 318.4 + 90) / 180)) - 90) AS delta, cos(radians(2 * (azimuth - 318.4))) AS cos2, anomaly FROM ({VFRAME}) f WHERE elongation >= 1.5"
_RP = perm_sql(f"SELECT plot_id, v - avg(v) OVER () AS c FROM ({_RES}) p")
_RSS = f"(SELECT var_pop(v) * count(*) FROM ({_RES}) q)"
_OBS_I = f"(SELECT sum(a.v * e.w * b.v) / {_RSS} FROM ({EDGES}) e JOIN ({_RES}) a USING (plot_id) JOIN ({_RES}) b ON b.plot_id = e.donor_id)"
VALIDATE = f"""SELECT 'reserved winner' AS test, winner AS item, m AS value FROM ({_TOP}) a UNION ALL SELECT 'named class against rest, p', '{NAMED}', CASE WHEN n1 >= 20 THEN p END FROM {_greater(f"cls = '{NAMED}'", 'reserved')} b
{" ".join(f"UNION ALL SELECT 'flagged against rest, p', '{d}', p FROM {_greater('flagged', d)} b" for d in ("early", "reserved", "late"))}
{" ".join(f"UNION ALL SELECT 'median', '{d} ' || CASE WHEN flagged THEN 'flagged' ELSE 'rest' END, median({d}) FROM ({VFRAME}) f GROUP BY flagged" for d in ("early", "reserved", "late"))}
UNION ALL SELECT 'reserved median', CASE WHEN cleared > 0.8 THEN 'cleared' ELSE 'standing' END, median(reserved) FROM ({VFRAME}) f WHERE cleared > 0.8 OR cleared < 0.2 GROUP BY 2
UNION ALL SELECT 'look direction cos rho', CASE WHEN abs(rho) > 0.2 THEN 'contaminated' ELSE 'clean' END, rho FROM ({spearman_sql(_LOOK, 'cos2', 'anomaly')}) c
UNION ALL SELECT 'look direction rho', CASE WHEN abs(rho) > 0.2 THEN 'contaminated' ELSE 'clean' END, rho FROM ({spearman_sql(_LOOK, 'delta', 'anomaly')}) c
UNION ALL SELECT 'residual autocorrelation', CASE WHEN count(*) FILTER (i >= o) = 0 THEN 'p<' ELSE 'p=' END || printf('%.3f', ((1.0 + count(*) FILTER (i >= o)) / (count(*) + 1.0))::DOUBLE), max(o) FROM
(SELECT i, {_OBS_I} AS o FROM (SELECT a.draw, sum(a.c * e.w * b.c) / {_RSS} AS i FROM ({EDGES}) e JOIN ({_RP}) a ON a.plot_id = e.plot_id JOIN ({_RP}) b ON b.plot_id = e.donor_id AND b.draw = a.draw GROUP BY 1) n) d"""


@query("job_validate", VALIDATE, f="value")
def _(t):
    return jobs.job_validate(validation_frame(t), B.points(t), NAMED, LOOK, draws=FOLDS)


# -- sign -------------------------------------------------------------------------------------
SFRAME = f"""SELECT plot_id, label::VARCHAR AS cls, x, y, v AS dep_a, b AS dep_b, fraction AS opt_a, weight / 10 + fraction / 2 AS opt_b, v * b AS cleared,
b - v AS d_dep, weight / 10 + fraction / 2 - fraction AS d_opt FROM ({B.POINTS}) p"""
_SALL = f"SELECT d_opt, d_dep, unnest([cls, 'ALL']) AS k FROM ({SFRAME}) s"
_SBLK = f"SELECT d_dep, d_opt, floor(x / 500)::BIGINT * 100000 + floor(y / 500)::BIGINT AS block FROM ({SFRAME}) s"
_SCOP = f"SELECT draw, d_dep, d_opt FROM (SELECT draw, d_dep, d_opt, unnest(range({poisson_sql('u')})) FROM (SELECT *, {uniform_sql('block', 'draw', 12)} AS u FROM {drawn(_SBLK, FOLDS)} e) a) c"
_SR = spearman_sql(_SCOP, "d_dep", "d_opt", "draw")
_SE = f"(SELECT [{', '.join(f'quantile_cont(opt_a, {i}/6::DOUBLE)' for i in range(7))}] FROM ({SFRAME}) z)"
_SQ = f"(SELECT quantile_cont(cleared, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM ({SFRAME}) z)"
SIGN = " UNION ALL ".join([
    *[f"SELECT 'same date' AS part, '{n}' AS item, rho AS value FROM ({spearman_sql(SFRAME, a, b)}) q" for n, a, b in (
        ("a", "dep_a", "opt_a"), ("b", "dep_b", "opt_b"), ("control", "dep_a", "opt_b"))],
    f"SELECT 'slope', k, CASE WHEN count(*) > 10 THEN regr_slope(d_dep, d_opt) END FROM ({_SALL}) s GROUP BY 2",
    f"SELECT 'blocks', 'lo', quantile_cont(rho, 0.025) FROM ({_SR}) r", f"SELECT 'blocks', 'hi', quantile_cont(rho, 0.975) FROM ({_SR}) r",
    f"SELECT 'blocks', 'rho', rho FROM ({spearman_sql(_SBLK, 'd_dep', 'd_opt')}) r",
    f"SELECT 'response', (1 + len(list_filter({_SE}[2:6], lambda q: opt_a >= q)))::VARCHAR, avg(dep_a) FROM ({SFRAME}) s GROUP BY 2",
    f"SELECT 'clearing', (1 + len(list_filter({_SQ}[2:5], lambda q: cleared > q)))::VARCHAR, median(d_opt) FROM ({SFRAME}) s GROUP BY 2"])


@query("job_sign_arbitration", SIGN, f="value")
def _(t):
    p = B.points(t).select("plot_id", F.col("label").cast("string").alias("cls"), "x", "y", F.col("v").alias("dep_a"), F.col("b").alias("dep_b"),
                           F.col("fraction").alias("opt_a"), (F.col("weight") / 10 + F.col("fraction") / 2).alias("opt_b"),
                           (F.col("v") * F.col("b")).alias("cleared"))
    return jobs.job_sign(p, draws=FOLDS)


# -- scene diagnostics ------------------------------------------------------------------------
_ALLC = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r, c) AS k FROM ({B.GRID}) g) x WHERE k = 7 AND r < (SELECT (max(r) + 1) // 2 * 2 FROM (SELECT r FROM ({B.GRID}) h GROUP BY r, c HAVING count(*) = 7) y)"
_FB = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY br, bc) AS k FROM (SELECT pass, r // 2 AS br, c // 2 AS bc, avg(value) AS value, count(*) AS n FROM ({_ALLC}) a GROUP BY 1, 2, 3) b WHERE n = 4) z WHERE k = 7"
_FT = f"SELECT br, bc, low FROM (SELECT *, quantile_cont(low, 0.5) OVER () AS cut FROM (SELECT br, bc, min(value) AS low FROM ({_FB}) f WHERE pass IN (1995, 1996, 1997) GROUP BY 1, 2) a) b WHERE low > cut"
_FO = f"SELECT pass, measured, CASE WHEN abs(measured) >= 0.02 THEN measured ELSE 0 END AS applied FROM (SELECT g.pass, median(10 * log10(m.value) - 10 * log10(g.value)) AS measured FROM ({_FB}) g JOIN ({_FB}) m ON m.br = g.br AND m.bc = g.bc AND m.pass = 1995 JOIN ({_FT}) k ON k.br = g.br AND k.bc = g.bc WHERE g.pass <> 2001 GROUP BY 1) o"
DIAGNOSTICS = f"""SELECT o.*, spread_db FROM ({_FO}) o, (SELECT max(level + applied) - min(level + applied) AS spread_db FROM (SELECT g.pass, 10 * log10(median(g.value)) AS level FROM ({_FB}) g JOIN ({_FT}) k ON k.br = g.br AND k.bc = g.bc GROUP BY 1) l
JOIN ({_FO}) p USING (pass) WHERE pass IN (1998, 2000)) s"""


@query("job_scene_diagnostics", DIAGNOSTICS, f="measured applied spread_db")
def _(t):
    offsets, spread = jobs.job_scene_diagnostics(
        B.grid(t), 7, 1995, (1995, 1996, 1997), (1998, 2000), skip=(2001,), factor=2, percentile=50, apply_min=0.02)
    return null_safe_join(offsets, spread.select("spread_db"), [])


# -- season context ---------------------------------------------------------------------------
_OD = "SELECT o_orderdate::DATE AS d, sum(o_totalprice) / 997000.0::DOUBLE AS v FROM orders GROUP BY 1"
_OE = f"SELECT d FROM ({_OD}) x"
_ST = f"SELECT year(d) AS y, sum(v) AS total FROM ({_OD}) d WHERE month(d) BETWEEN 6 AND 11 GROUP BY 1"
_SS4 = f"SELECT max(total) FILTER (y = 1999) AS total, avg(total) FILTER (y BETWEEN 1995 AND 1998) AS mean, stddev_samp(total) FILTER (y BETWEEN 1995 AND 1998) AS sd, median(total) FILTER (y BETWEEN 1995 AND 1998) AS median FROM ({_ST}) t"
_CYEARS = "SELECT o_orderpriority AS cls, year(o_orderdate)::BIGINT AS year, sum(o_totalprice) / 997000.0::DOUBLE AS v FROM orders GROUP BY 1, 2"
SEASON = " UNION ALL ".join([
    *[f"SELECT 'season' AS part, '{n}' AS item, {e} AS value FROM ({_SS4}) s" for n, e in (
        ("total", "total"), ("mean", "mean"), ("sd", "sd"), ("median", "median"),
        ("anomaly_pct", "100 * (total - mean) / mean"), ("z", "(total - mean) / sd"))],
    f"SELECT 'api', strftime(e.d, '%Y-%m-%d'), coalesce(sum(p.v * pow(0.9, date_diff('day', p.d, e.d))), 0) FROM ({_OE}) e LEFT JOIN ({_OD}) p ON p.d BETWEEN e.d - 14 AND e.d - 1 GROUP BY 2",
    f"SELECT 'year', cls, 100 * max(v) FILTER (year = 1999) / avg(v) FILTER (year < 1999) FROM ({_CYEARS}) c WHERE year BETWEEN 1995 AND 1999 GROUP BY 2"])


@query("job_season_context", SEASON, f="value")
def _(t):
    days = order_days(t)
    return jobs.job_season_context(days, class_years(t), days.select("d"), 1999, (1995, 1998))


# -- optical ----------------------------------------------------------------------------------
_CAT = """SELECT event_id, ts::DATE AS d, ((day(ts) - 1) // 5) AS "window", CASE WHEN event_type = 'error' THEN 100.0 ELSE json_extract(props, '$.k')::DOUBLE END AS cloud FROM events"""
_VAL = """SELECT (day(ts) - 1) // 5 AS "window", ts::DATE AS d, avg((value < 70)::INTEGER) AS valid_share FROM events GROUP BY 1, 2"""
_PICK = f"""SELECT "window", d FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY cloud, d) AS rn FROM (SELECT "window", d, avg(cloud) AS cloud FROM ({_CAT}) i GROUP BY 1, 2) c JOIN ({_VAL}) v USING ("window", d)
WHERE cloud <= 80 AND valid_share >= 0.75) r WHERE rn = 1"""
_BANDS = """SELECT (day(ts) - 1) // 5 AS "window", ts::DATE AS d, user_id // 12 AS r, user_id % 12 AS c, event_id AS src_order, (3 + event_id % 4)::INTEGER AS cls,
value / 0.997::DOUBLE - 1 AS red, value * value / 0.997::DOUBLE / 20 AS nir FROM events"""
_IDX = f"""SELECT "window", r, c, CASE WHEN cls IN (4, 5, 6, 7) AND nir > 0 AND red > 0 THEN (nir - red) / (nir + red) END AS value FROM (SELECT "window", r, c, arg_min(cls, src_order) FILTER (cls > 0) AS cls, arg_min(red, src_order) FILTER (red > 0) AS red, arg_min(nir, src_order) FILTER (nir > 0) AS nir
FROM ({_BANDS}) x JOIN ({_PICK}) k USING ("window", d) GROUP BY 1, 2, 3) t"""
_FLAB = "SELECT user_id AS plot_id, user_id // 12 * 4 + i AS r, user_id % 12 * 4 + j AS c FROM (SELECT DISTINCT user_id FROM events UNION SELECT 1000000 + s_suppkey FROM supplier) u, (SELECT unnest(range(4)) AS i) a, (SELECT unnest(range(4)) AS j) b"
_FINE = f"""SELECT plot_id, "window", r, c, sum(w * value) / nullif(sum(w) FILTER (value IS NOT NULL), 0) AS nd, sum(w * (value IS NOT NULL)::INTEGER) / sum(w) AS m FROM (SELECT p.plot_id, k."window", p.r, p.c, k.value,
(CASE WHEN a.i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b.j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM (SELECT *, (r + 0.5) / 4.0::DOUBLE - 0.5 AS y, (c + 0.5) / 4.0::DOUBLE - 0.5 AS x FROM ({_FLAB}) f) p,
(SELECT unnest(range(2)) AS i) a, (SELECT unnest(range(2)) AS j) b JOIN ({_IDX}) k ON k.r = floor(y) + a.i AND k.c = floor(x) + b.j) z GROUP BY 1, 2, 3, 4"""
OPTICAL = f"""SELECT plot_id, "window", mean, coalesce(valid_share, 0) AS valid_share FROM (SELECT * FROM (SELECT DISTINCT plot_id FROM ({_FLAB}) l) p, (SELECT DISTINCT "window" FROM ({_PICK}) k) w) f LEFT JOIN
(SELECT plot_id, "window", avg(nd) FILTER (m > 0.5) AS mean, count(nd) FILTER (m > 0.5) / 16.0 AS valid_share FROM ({_FINE}) q GROUP BY 1, 2) o USING (plot_id, "window")"""


@query("job_optical", OPTICAL, f="mean valid_share")
def _(t):
    day = F.to_date("ts")
    e = t.events
    items = catalogue(t).withColumn("window", F.floor((F.dayofmonth("d") - 1) / 5))
    valid = e.groupBy(B.slot().alias("window"), day.alias("d")).agg(F.avg((F.col("value") < 70).cast("int")).alias("valid_share"))
    u = F.col("user_id")
    bands = e.select(B.slot().alias("window"), day.alias("d"), F.floor(u / 12).alias("r"), (u % 12).alias("c"), F.col("event_id").alias("src_order"),
                     (3 + F.col("event_id") % 4).cast("int").alias("cls"), (F.col("value") / B.UNTIE - 1).alias("red"),
                     (F.col("value") * F.col("value") / B.UNTIE / 20).alias("nir"))
    four = F.sequence(F.lit(0), F.lit(3))
    # Suppliers are plots far off the coarse grid, which no scene covers.
    far = t.supplier.select((1000000 + F.col("s_suppkey")).alias("plot_id"))
    labels = e.select(u.alias("plot_id")).union(far).distinct().select("plot_id", F.explode(four).alias("i")).select("plot_id", "i", F.explode(four).alias("j"))
    p = F.col("plot_id")
    labels = labels.select("plot_id", (F.floor(p / 12) * 4 + F.col("i")).alias("r"), ((p % 12) * 4 + F.col("j")).alias("c"))
    return jobs.job_optical(items, valid, bands, labels, 4, min_valid=0.75, required=(0, 1, 2))


# -- second sensor ----------------------------------------------------------------------------
_SEC = f"""SELECT user_id AS plot_id, {B.SLOT} AS pass, ({B.SLOT} * 5 + 3)::DOUBLE AS doy, avg(value) / 0.997::DOUBLE AS v FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1, 2, 3"""
_SDEP = f"SELECT plot_id, pass, doy, v - avg(v) FILTER (rn <= 2) OVER (PARTITION BY plot_id) AS departure FROM (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY doy) AS rn FROM ({_SEC}) s) r"
_TZ = "SELECT plot_id, sum(a) / nullif(max(doy) - min(doy), 0) AS i FROM (SELECT *, (doy - lag(doy) OVER w) * (departure + lag(departure) OVER w) / 2 AS a FROM ({src}) o WINDOW w AS (PARTITION BY plot_id ORDER BY doy)) s GROUP BY 1"
_CH = f"SELECT plot_id, max(departure) FILTER (pass = 5) - max(departure) FILTER (pass = 3) AS {{n}} FROM ({{src}}) d GROUP BY 1"
_OWN = f"SELECT own, change FROM ({_CH.format(n='own', src=_SDEP)}) a JOIN ({_CH.format(n='change', src=B.DEP)}) b USING (plot_id) WHERE own IS NOT NULL AND change IS NOT NULL"
_SAMP = f"SELECT a.i AS a, b.i AS b FROM ({_TZ.format(src=_SDEP)}) a JOIN ({_TZ.format(src=f'SELECT * FROM ({_SDEP}) d WHERE pass <> 4')}) b USING (plot_id) WHERE a.i IS NOT NULL AND b.i IS NOT NULL"
WITNESS = f"""SELECT 'projection' AS part, cls AS item, median(departure) FILTER (pass = 5) - median(departure) FILTER (pass = 1) AS value FROM ({_SDEP}) d JOIN ({B.PLOTS}) p USING (plot_id) GROUP BY 2
UNION ALL SELECT 'cross sensor', 'rho', rho FROM ({spearman_sql(_OWN, 'own', 'change')}) s UNION ALL SELECT 'sampling', 'rho', rho FROM ({spearman_sql(_SAMP, 'a', 'b')}) s"""
WITNESS = WITNESS.replace("FILTER (pass = 1) AS value", "FILTER (pass = 3) AS value")


@query("job_witness", WITNESS, f="value")
def _(t):
    s = t.events.where("event_type in ('view', 'click', 'signup')").groupBy(
        F.col("user_id").alias("plot_id"), B.slot().alias("pass")).agg((F.avg("value") / B.UNTIE).alias("v")).select(
        "plot_id", "pass", (F.col("pass") * 5 + 3).cast("double").alias("doy"), "v")
    change = B.dep(t).groupBy("plot_id").agg(
        (series.at_pass(5, "departure") - series.at_pass(3, "departure")).alias("change"))
    return jobs.job_witness(s, B.plots(t), change, late=(3, 5), drop=(4,))
