"""Aggregations, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import rollup, zonal
from fieldspark.plans import bindings as B
from fieldspark.plans.registry import query
from fieldspark.sources.stage import materialise

# Every supplier is a plot, one more besides, so that some plots have no cell.
CORE = f"""SELECT s_suppkey AS plot_id, 1 + s_nationkey AS core_cells FROM supplier UNION ALL SELECT -1, 5"""
ZONAL = f"""SELECT plot_id, core_cells, pass, coalesce(n, 0) AS n, mean, CASE WHEN n > 1 THEN var END AS var, CASE WHEN n > 1 AND mean > 0 THEN sqrt(var) / mean END AS cov,
CASE WHEN n > 1 AND var > 0 THEN mean * mean / var END AS enl, coalesce(n, 0) / core_cells::DOUBLE AS coverage FROM (SELECT * FROM ({CORE}) k, (SELECT DISTINCT pass FROM ({B.CELLS}) c) s) f LEFT JOIN
(SELECT plot_id, pass, count(*) AS n, avg(value) AS mean, greatest(0, sum(value * value) / count(*) - avg(value) * avg(value)) AS var FROM ({B.CELLS}) c GROUP BY 1, 2) a USING (plot_id, pass)"""


@query("zonal_stats", ZONAL, f="mean var cov enl coverage", nd=3)
def _(t):
    core = t.supplier.select(F.col("s_suppkey").alias("plot_id"), (1 + F.col("s_nationkey")).alias("core_cells"))
    extra = t.supplier.limit(1).select(F.lit(-1).cast("long").alias("plot_id"), F.lit(5).alias("core_cells"))
    return zonal.zonal_stats(B.cells(t), core.unionAll(extra))


@query("zonal_mean_coverage", f"""SELECT plot_id, pass, avg(v) AS mean, count(v) / count(*)::DOUBLE AS valid_share FROM
(SELECT plot_id, pass, CASE WHEN value > 20000 THEN value END AS v FROM ({B.CELLS}) c) x GROUP BY 1, 2""", f="mean valid_share", nd=4)
def _(t):
    c = B.cells(t).withColumn("value", F.when(F.col("value") > 20000, F.col("value")))
    return zonal.zonal_mean(c, ["plot_id", "pass"])


BLOCKS = f"""SELECT pass, r // 4 AS br, c // 4 AS bc, avg(value) AS value, count(*) AS n, count(*) = 16 AS "full" FROM ({B.GRID}) g
WHERE r < (SELECT (max(l_suppkey) + 1) // 4 * 4 FROM lineitem) GROUP BY 1, 2, 3"""


@query("block_mean", BLOCKS, f="value", nd=4)
def _(t):
    return zonal.block_mean(B.grid(t), 4)


@query("covalid", f"""SELECT count(*) FILTER (n = 7) AS covalid_cells, count(*) AS all_cells, count(*) FILTER (n = 7) / count(*)::DOUBLE AS covalid_share
FROM (SELECT r, c, count(DISTINCT pass) AS n FROM ({B.GRID}) g WHERE value > 0 GROUP BY 1, 2) x""", f="covalid_share")
def _(t):
    return zonal.covalid_share(B.grid(t), 7)


GROUND = f"""SELECT g.*, min(value) FILTER (pass <> 1999) OVER (PARTITION BY r, c) AS low FROM (SELECT r, c, pass,
value * pow(10, CASE WHEN pass = 1997 THEN 0.05 ELSE 0 END / 10) AS value, count(*) OVER (PARTITION BY r, c) AS n FROM ({B.GRID}) q) g WHERE n = 7 AND c >= 6"""
DRIFT = f"""SELECT pass, level_db, level_db - max(level_db) FILTER (pass = 1995) OVER () AS drift_db FROM
(SELECT pass, median(10 * log10(value)) AS level_db FROM ({GROUND}) x WHERE low <= (SELECT quantile_cont(low, 0.99) FROM ({GROUND}) y WHERE pass = 1995)
AND pass <> 1999 GROUP BY 1) z"""


def scene_drift(t):
    offsets = t.lineitem.where("l_shipdate >= '1997-01-01' and l_shipdate < '1998-01-01'").select(F.lit(1997).cast("long").alias("pass")).distinct().withColumn(
        "applied", F.lit(0.05))
    level = [p for p in B.PASSES if p != 1999]
    return zonal.scene_drift(B.grid(t), B.grid_labels(t), offsets, level, 7, 1995)


@query("scene_drift", DRIFT, f="level_db drift_db", cast="pass:INTEGER")
def _(t):
    return scene_drift(t)


def blocks(t):
    return materialise(B.grid(t).withColumnsRenamed({"r": "br", "c": "bc"}))


TARGETS = f"""SELECT br, bc, low FROM (SELECT r AS br, c AS bc, min(value) AS low FROM ({B.GRID}) g WHERE pass IN (1995, 1996, 1997) GROUP BY 1, 2) x
WHERE low > (SELECT quantile_cont(low, 0.5) FROM (SELECT min(value) AS low FROM ({B.GRID}) g WHERE pass IN (1995, 1996, 1997) GROUP BY r, c) y)"""


@query("stable_targets", TARGETS, f="low")
def _(t):
    return zonal.stable_targets(blocks(t), (1995, 1996, 1997), 50)


OFFS = f"""SELECT pass, measured, CASE WHEN abs(measured) >= 0.02 THEN measured ELSE 0 END AS applied FROM (SELECT g.pass, median(10 * log10(m.value) - 10 * log10(g.value)) AS measured
FROM ({B.GRID}) g JOIN ({B.GRID}) m ON m.r = g.r AND m.c = g.c AND m.pass = 1995 JOIN ({TARGETS}) k ON k.br = g.r AND k.bc = g.c WHERE g.pass <> 2001 GROUP BY 1) o"""


def targets_offsets(t):
    b = blocks(t)
    targets = zonal.stable_targets(b, (1995, 1996, 1997), 50)
    targets = materialise(targets)
    return b, targets, zonal.pass_offsets(b, targets, 1995, skip=(2001,), apply_min=0.02)


@query("pass_offsets", OFFS, f="measured applied")
def _(t):
    return targets_offsets(t)[2]


_WIDE = f"""SELECT r, c, 10 * log10(min(value) FILTER (pass IN (1995, 1996, 1997))) AS axis, 10 * log10(max(value) FILTER (pass = 1995)) AS a,
10 * log10(max(value) FILTER (pass = 1998)) AS b FROM ({B.GRID}) g GROUP BY 1, 2"""
_EDGES = f"(SELECT quantile_cont(axis, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FROM ({_WIDE}) w)"
DECILES = f"""SELECT decile::INTEGER AS decile, count(*) AS n, max(e[decile]) AS lo, max(e[decile + 1]) AS hi, median(a - b) AS median_gap FROM (SELECT *, 1 + len(list_filter(e[2:10], lambda q: axis >= q)) AS decile
FROM (SELECT *, {_EDGES} AS e FROM ({_WIDE}) w) x WHERE axis IS NOT NULL) y GROUP BY 1"""


@query("decile_profile", DECILES, f="lo hi median_gap")
def _(t):
    return zonal.decile_profile(blocks(t), 1995, 1998, (1995, 1996, 1997), min_count=1)


@query("holdout_spread", f"""SELECT max(level + applied) - min(level + applied) AS spread_db, max(level) - min(level) AS raw_spread_db, max(level + applied) - min(level + applied) <= 1.5 AS passed
FROM (SELECT g.pass, 10 * log10(median(g.value)) AS level FROM ({B.GRID}) g JOIN ({TARGETS}) k ON k.br = g.r AND k.bc = g.c GROUP BY 1) l JOIN ({OFFS}) o USING (pass) WHERE pass IN (1998, 2000)""",
       f="spread_db raw_spread_db")
def _(t):
    b, targets, offsets = targets_offsets(t)
    return zonal.holdout_spread(b, targets, offsets, (1998, 2000))


@query("fingerprint", f"SELECT pass, count(*) AS n, sum(value) AS total, sum(value * value) AS total_sq FROM ({B.GRID}) g GROUP BY 1", f="total total_sq", nd=0)
def _(t):
    return zonal.fingerprint(B.grid(t))


REF_PLOTS = f"SELECT *, {B.sql_map(B.REFERENCE)} AS reference, value * weight AS production FROM ({B.PLOTS}) p"
ROLLUP = f"""SELECT coalesce(cls, 'ALL') AS cls, count(*) AS n, sum(weight) AS weight, CASE WHEN grouping(cls) = 0 THEN max(reference) END AS reference,
sum(value * weight) / sum(weight) AS value_wt, sum(production) AS production, sum(fraction * weight) / sum(weight) AS fraction_wt,
coalesce(sum(weight) FILTER (confidence = 'high'), 0) / sum(weight) AS high_share, sum(weight) / (SELECT sum(p_size) FROM part) AS weight_share,
quantile_cont(value, 0.1) AS value_p10, quantile_cont(value, 0.9) AS value_p90 FROM ({REF_PLOTS}) p GROUP BY ROLLUP(cls)"""


def ref_plots(t):
    from fieldspark.functions.expr import lookup
    return B.plots(t).withColumns({"reference": lookup(F.col("cls"), B.REFERENCE, "reference"),
                                   "production": F.col("value") * F.col("weight")})


def weighted_rollup(t):
    return rollup.weighted_rollup(ref_plots(t))


@query("weighted_rollup", ROLLUP, f="weight value_wt production fraction_wt high_share weight_share value_p10 value_p90")
def _(t):
    return weighted_rollup(t)


ZONES = f"""SELECT zx, zy, count(*) AS n, sum(weight) AS weight, sum(weight * v) / sum(weight) AS value_wt, sum(weight * v) AS production, max(dominant) AS dominant,
avg((v > 0)::INTEGER) AS measured_share, median(fraction) AS fraction_median FROM (SELECT *, first_value(label) OVER (PARTITION BY zx, zy ORDER BY cw DESC, label) AS dominant FROM
(SELECT *, sum(weight) OVER (PARTITION BY zx, zy, label) AS cw FROM (SELECT *, floor((x - min(x) OVER ()) / 500)::BIGINT AS zx, floor((y - min(y) OVER ()) / 500)::BIGINT AS zy FROM ({B.POINTS}) p) a) b) c
GROUP BY 1, 2 HAVING count(*) >= 5"""


@query("zone_rollup", ZONES, f="weight value_wt production measured_share fraction_median")
def _(t):
    p = B.points(t).withColumnsRenamed({"v": "value", "label": "cls"}).withColumns({
        "production": F.col("weight") * F.col("value"),
        "data_quality": F.when(F.col("value") > 0, "measured").otherwise("imputed")})
    return rollup.zone_rollup(p)


@query("argmax_category", f"SELECT cls, arg_min(brand, (-n, brand)) AS mode FROM (SELECT cls, brand, count(*) AS n FROM ({B.PLOTS}) p GROUP BY 1, 2) q GROUP BY 1")
def _(t):
    return rollup.mode_low(B.plots(t), ["cls"], "brand")


_QS = ", ".join(f"{f}({c}) AS {c}_{n}" for c in ("value", "weight") for f, n in (("min", "min"), ("max", "max"))) + ", " + ", ".join(
    f"quantile_cont({c}, {p}) AS {c}_{n}" for c in ("value", "weight") for p, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")))


@query("quantile_summary", f"SELECT cls, {_QS} FROM ({B.PLOTS}) p GROUP BY 1",
       f=" ".join(f"{c}_{n}" for c in ("value", "weight") for n in ("min", "max", "p10", "p50", "p90")))
def _(t):
    return rollup.quantile_summary(B.plots(t), ["cls"], ["value", "weight"])


@query("degenerate_share", f"""SELECT cls, avg((abs(value - m) <= 1e-8 + 1e-5 * abs(m))::INTEGER) AS value_on_median, avg((abs(weight - w) <= 1e-8 + 1e-5 * abs(w))::INTEGER) AS weight_on_median
FROM (SELECT *, median(value) OVER (PARTITION BY cls) AS m, median(weight) OVER (PARTITION BY cls) AS w FROM ({B.PLOTS}) p) q GROUP BY 1""", f="value_on_median weight_on_median")
def _(t):
    return rollup.degenerate_share(B.plots(t), "cls", ["value", "weight"])


@query("tie_audit", f"""SELECT sum(n)::BIGINT AS n, count(*) AS n_distinct, sum(n) FILTER (n > 1)::BIGINT AS n_tied, sum(w) FILTER (n > 1) AS weight_tied, max(n) AS largest_run,
sum(n) FILTER (axis <= 0)::BIGINT AS n_tied_clipped, sum(w) FILTER (axis <= 0) AS weight_tied_clipped, count(*) FILTER (axis <= 0) AS n_distinct_clipped FROM
(SELECT weight - 20 AS axis, count(*) AS n, sum(value) AS w FROM ({B.PLOTS}) p GROUP BY 1) q""", f="weight_tied weight_tied_clipped")
def _(t):
    return rollup.tie_audit(B.plots(t).withColumn("axis", F.col("weight") - 20), "axis", "value")


@query("ledger_tally", """SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS n FROM orders""")
def _(t):
    return rollup.tally(t.orders, ["F", "O", "P"], "o_orderstatus")


_YEARS = "SELECT o_orderdate::DATE AS d, sum(o_totalprice) / 997000.0::DOUBLE AS v FROM orders GROUP BY 1"


def order_days(t):
    return t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 997000.0).alias("v"))


@query("season_totals", f"""SELECT *, 100 * (total - mean) / mean AS anomaly_pct, (total - mean) / sd AS z FROM (SELECT max(total) FILTER (y = 1999) AS total, avg(total) FILTER (y BETWEEN 1995 AND 1998) AS mean,
stddev_samp(total) FILTER (y BETWEEN 1995 AND 1998) AS sd, median(total) FILTER (y BETWEEN 1995 AND 1998) AS median FROM
(SELECT year(d) AS y, sum(v) AS total FROM ({_YEARS}) d WHERE month(d) BETWEEN 6 AND 11 GROUP BY 1) t) s""", f="total mean sd median anomaly_pct z", nd=4)
def _(t):
    return rollup.season_anomaly(order_days(t), 1999, (1995, 1998))


_CY = "SELECT o_orderpriority AS cls, year(o_orderdate)::BIGINT AS year, sum(o_totalprice) / 997000.0::DOUBLE AS v FROM orders GROUP BY 1, 2"


def class_years(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("cls"), F.year("o_orderdate").cast("long").alias("year")).agg(
        (F.sum("o_totalprice") / 997000.0).alias("v"))


YEARS = f"""SELECT cls, now AS year_v, prior AS prior_mean, 100 * now / prior AS pct_of_prior_mean, 100 * (now / last - 1) AS vs_last_year_pct, rk AS rank_of_span FROM
(SELECT cls, max(v) FILTER (year = 1999) AS now, avg(v) FILTER (year < 1999) AS prior, max(v) FILTER (year = 1998) AS last, count(*) FILTER (v <= n) AS rk FROM
(SELECT *, max(v) FILTER (year = 1999) OVER (PARTITION BY cls) AS n FROM ({_CY}) c WHERE year BETWEEN 1995 AND 1999) w GROUP BY 1) q"""


@query("year_context", YEARS, f="year_v prior_mean pct_of_prior_mean vs_last_year_pct", nd=4)
def _(t):
    return rollup.year_context(class_years(t), 1999)


@query("label_agreement", f"""SELECT count(*) AS n, avg(same) AS agreement, count(*) FILTER (sure) AS n_sure, avg(same) FILTER (sure) AS agreement_sure,
sum(weight) FILTER (same = 1) AS weight_same, sum(weight) AS weight FROM (SELECT weight, (cls = cls2)::INTEGER AS same, confidence = 'high' AND value >= 1 AS sure FROM
(SELECT *, CASE WHEN weight < 40 THEN cls ELSE 'PROMO' END AS cls2 FROM ({B.PLOTS}) p) q) r""", f="agreement agreement_sure weight_same weight")
def _(t):
    p = B.plots(t)
    other = p.select("plot_id", F.when(F.col("weight") < 40, F.col("cls")).otherwise("PROMO").alias("cls"),
                     F.when(F.col("value") >= 1, "high").otherwise("low").alias("confidence"))
    return rollup.label_agreement(p, other)


@query("cohort_trajectory", f"SELECT pass % 2 AS cls, pass, count(v) AS n, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM ({B.OBS}) o GROUP BY 1, 2", f="q25 q50 q75")
def _(t):
    return rollup.cohort_trajectory(B.obs(t).withColumn("cls", F.col("pass") % 2))


# Fixed values of the binding: a prior share per class.
PRIOR = {"ECONOMY": 0.16, "LARGE": 0.18, "MEDIUM": 0.14, "PROMO": 0.20, "SMALL": 0.15, "STANDARD": 0.17}
_LR = f"""SELECT cls, share AS measured_share, {B.sql_map(PRIOR)} AS prior_share, ln(share / {B.sql_map(PRIOR)}) AS log_ratio FROM
(SELECT cls, sum(weight) / (SELECT sum(p_size) FROM part) AS share FROM ({B.PLOTS}) p GROUP BY 1) q WHERE cls IN ('PROMO', 'ECONOMY')"""


def log_ratios(t):
    return rollup.prior_log_ratio(B.plots(t), PRIOR, ("PROMO", "ECONOMY"))


@query("prior_log_ratio", f"SELECT l.*, (SELECT stddev_samp(log_ratio) FROM ({_LR}) m) AS sigma FROM ({_LR}) l", f="measured_share prior_share log_ratio sigma")
def _(t):
    from fieldspark.operators.ordered import null_safe_join
    r = log_ratios(t)
    return null_safe_join(r, rollup.prior_sigma(r), [])


@query("extrapolated_summary", f"SELECT cls, count(*) AS n, avg(fraction) AS mean_fraction, count(*) FILTER (fraction < 0.01) AS n_observed, quantile_cont(fraction, 0.9) AS p90_fraction FROM (SELECT cls, fraction - 0.02 AS fraction FROM ({B.PLOTS}) p) q GROUP BY 1", f="mean_fraction p90_fraction")
def _(t):
    return rollup.extrapolated_summary(B.plots(t).withColumn("fraction", F.col("fraction") - 0.02))


@query("separability", f"""SELECT (SELECT max(m) - min(m) FROM (SELECT avg(v) AS m FROM ({B.POINTS}) p GROUP BY label) q) AS class_spread, 4.34 / sqrt(median(weight)) AS speckle_floor_db,
count(*) FILTER (fraction < 0.05) AS n_low_margin, count(*) AS n, median(y - x) AS median_rise FROM ({B.POINTS}) p""", f="class_spread speckle_floor_db median_rise")
def _(t):
    p = B.points(t).select(F.col("label").alias("cls"), F.col("v").alias("value"), F.col("fraction").alias("margin"),
                           F.col("weight").alias("cells"), F.col("x").alias("early"), F.col("y").alias("late"))
    return rollup.separability(p)


@query("null_ablation", f"""SELECT *, 100 * (total - null_total) / null_total AS diff_pct FROM (SELECT sum(value * weight) AS total, sum(reference * weight) AS null_total,
count(*) FILTER (abs(value - reference) / reference > 0.05) AS n_moved_5pct, median(abs(value - reference) / reference) AS median_move, quantile_cont(abs(value - reference) / reference, 0.9) AS p90_move
FROM (SELECT * REPLACE (value + 0.6 AS value) FROM ({REF_PLOTS}) r) p) q""", f="total null_total median_move p90_move diff_pct")
def _(t):
    return rollup.null_ablation(ref_plots(t).withColumn("value", F.col("value") + 0.6))


@query("coverage_table", """SELECT CASE WHEN n_valid = 6 THEN 'measured' WHEN n_valid >= 4 THEN 'interpolated' ELSE 'imputed' END AS data_quality, count(*) AS n, count(*) FILTER (n_valid / 6.0 >= 0.9) AS n_covered
FROM (SELECT user_id, count(DISTINCT (day(ts) - 1) // 5) AS n_valid FROM events WHERE event_type = 'purchase' GROUP BY 1) q GROUP BY 1""")
def _(t):
    from fieldspark.functions.expr import quality_flag
    n = B.gaps(t).groupBy("plot_id").agg(F.count(F.lit(1)).alias("n_valid"))
    d = n.select("plot_id", quality_flag(F.col("n_valid"), 6, 4).alias("data_quality"),
                 (F.col("n_valid") / 6.0).alias("coverage"))
    return rollup.coverage_table(d, 0.9)
