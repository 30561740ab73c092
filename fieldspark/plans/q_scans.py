"""Scans, sinks and column expressions, bound to the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldspark.functions import expr as X
from fieldspark.operators import geometry, rollup, series, zonal
from fieldspark.plans import bindings as B
from fieldspark.plans.registry import query
from fieldspark.sources import io
from fieldspark.sources.stage import stage_root


def folder(t) -> str:
    return f"{stage_root(t.spark)}/files-{uuid.uuid4().hex}"


@query("scan_labels", "SELECT doc_id AS plot_id, quality AS label FROM labels")
def _(t):
    path = folder(t)
    t.labels.write.csv(path, header=True)
    return io.read_labels(t.spark, path, "doc_id BIGINT, quality INT, toxic INT",
                          {"doc_id": "plot_id", "quality": "label"})


CATALOGUE = """SELECT 'S' || event_id AS id, ts::DATE AS d,
CASE WHEN event_type = 'error' THEN 100.0 ELSE json_extract(props, '$.k')::DOUBLE END AS cloud FROM events"""


def catalogue(t):
    """Events written as a scene catalogue; errors carry no cloud value."""
    path = folder(t)
    cloud = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("double"))
    feature = F.struct(
        F.concat(F.lit("S"), F.col("event_id")).alias("id"),
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
                 cloud.alias("eo:cloud_cover")).alias("properties"))
    t.events.select(F.array(feature).alias("features")).write.json(path)
    return io.read_catalogue(t.spark, path, multi_line=False)


@query("scan_catalogue", CATALOGUE)
def _(t):
    return io.least_cloudy_first(catalogue(t)).select("id", "d", "cloud")


@query("scan_daily_json", B.DAILY, f="v")
def _(t):
    path = folder(t)
    entry = F.struct(F.date_format("d", "yyyyMMdd").alias("key"), F.col("v").alias("value"))
    doc = B.daily(t).groupBy("source").agg(F.map_from_entries(F.collect_list(entry)).alias("parameter"))
    doc.select(F.to_json(F.struct("source", "parameter"))).write.text(path)
    return io.read_daily(t.spark, path)


@query("scan_cells", B.GRID, f="value")
def _(t):
    path = folder(t)
    B.grid(t).write.parquet(path)
    return io.read_cells(t.spark, path)


@query("scan_polygons", f"SELECT plot_id, 4 AS n_vertices, cx - hx AS first_x FROM ({B.RECT}) r")
def _(t):
    path = folder(t)
    B.rectangles(t).select("plot_id", "region", "parts").write.json(path)
    p = io.read_plots(t.spark, path, "json")
    return p.select("plot_id", F.size(F.col("parts")[0]).alias("n_vertices"),
                    F.col("parts")[0][0]["x"].alias("first_x"))


@query("scan_text", """SELECT length(line) AS length, count(*) AS n FROM
(SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents) l GROUP BY 1""", cast="length:INTEGER")
def _(t):
    path = folder(t)
    t.documents.select("text").write.text(path)
    return io.read_text(t.spark, path).groupBy(F.length("value").alias("length")).agg(
        F.count(F.lit(1)).alias("n"))


@query("sink_stage", B.PLOTS, f="value fraction")
def _(t):
    return io.write_stage(B.plots(t), folder(t))


@query("sink_per_window", f"SELECT pass AS \"window\", count(*) AS n, sum(v) AS v FROM ({B.OBS}) o GROUP BY 1", f="v")
def _(t):
    path = folder(t)
    o = B.obs(t).withColumnRenamed("pass", "window")
    for w in range(6):
        io.append_window(o.where(F.col("window") == w), path)
    # A late rerun of one window replaces that window only.
    io.append_window(o.where(F.col("window") == 5), path)
    back = t.spark.read.schema("plot_id BIGINT, doy DOUBLE, v DOUBLE, window BIGINT").parquet(path)
    return back.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


OFFSETS = f"""SELECT pass, median(ref - db) AS measured FROM (SELECT g.pass, 10 * log10(g.value) AS db,
10 * log10(m.value) AS ref FROM ({B.GRID}) g JOIN ({B.GRID}) m ON m.r = g.r AND m.c = g.c AND m.pass = 1995) x GROUP BY 1"""


@query("sidecar_offsets", f"""SELECT pass, measured, CASE WHEN abs(measured) >= 0.02 THEN measured ELSE 0.0 END
AS applied FROM ({OFFSETS}) o""", f="measured applied")
def _(t):
    path = folder(t)
    blocks = B.grid(t).withColumnsRenamed({"r": "br", "c": "bc"})
    io.write_offsets(zonal.pass_offsets(blocks, blocks.select("br", "bc").distinct(), 1995, apply_min=0.02), path)
    return io.read_offsets(t.spark, path)


# -- expressions ------------------------------------------------------------------------------
# Fixed values of the binding: calibration metadata per pass.
SCALE, CENTRE, NEAR, SPACING, HEIGHT, RADIUS, NOISE_POLY = 1.5, 28.7, 600000.0, 0.5, 525000.0, 6371000.0, (-20.0, 1e-6, 2e-13)
_COS = (f"greatest(-1, least(1, (pow({RADIUS + HEIGHT}, 2) - pow(s, 2) - pow({RADIUS}, 2)) / (2 * s * {RADIUS})))")
ANGLE = f"""SELECT *, degrees(acos({_COS})) + ({CENTRE} - degrees(acos({_COS.replace('(s, 2)', '(sm, 2)').replace('* s *', '* sm *')}))) AS incidence
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS i, l_linenumber::DOUBLE AS q,
{NEAR} + l_orderkey * {SPACING} AS s, {NEAR} + (SELECT (max(l_orderkey) + 1) / 2 FROM lineitem) * {SPACING} AS sm FROM lineitem) a"""
NOISE = f"pow(10, ({NOISE_POLY[0]} + {NOISE_POLY[1]} * l_orderkey + {NOISE_POLY[2]} * l_orderkey * l_orderkey) / 10)"


def samples(t):
    from fieldspark.operators.ordered import attach
    s = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("i"),
                          F.col("l_linenumber").cast("double").alias("q"))
    s = attach(s, [], {"columns": (F.max("l_orderkey") + 1).cast("double")})
    return s.withColumns({
        "incidence": X.incidence_deg(F.col("l_orderkey").cast("double"), F.col("columns"), F.lit(NEAR),
                                     F.lit(SPACING), F.lit(HEIGHT), F.lit(RADIUS), F.lit(CENTRE)),
        "noise": X.from_db(X.poly_eval(F.col("l_orderkey").cast("double"),
                                       F.array(*[F.lit(c) for c in NOISE_POLY])))})


@query("incidence_angle", f"SELECT l_orderkey, l_linenumber, incidence FROM ({ANGLE}) x", f="incidence")
def _(t):
    return samples(t).select("l_orderkey", "l_linenumber", "incidence")


@query("poly_eval", f"SELECT l_orderkey, l_linenumber, {NOISE} AS noise FROM lineitem", f="noise", nd=9)
def _(t):
    return samples(t).select("l_orderkey", "l_linenumber", "noise")


@query("calibrate_samples", f"""SELECT l_orderkey, l_linenumber, CASE WHEN i * i + q * q > 0 THEN
greatest((i * i + q * q) * {SCALE * SCALE} * sin(radians(incidence)) - {NOISE}, {NOISE} * 0.01)
/ cos(radians(incidence)) ELSE 0 END AS gamma FROM ({ANGLE}) x""", f="gamma")
def _(t):
    return samples(t).select("l_orderkey", "l_linenumber", X.calibrated_gamma(
        F.col("i"), F.col("q"), F.lit(SCALE), F.col("incidence"), F.col("noise")).alias("gamma"))


@query("to_db", """SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice - 20000 > 0
THEN 10 * log10(l_extendedprice - 20000) END AS db FROM lineitem""", f="db")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             X.to_db(F.col("l_extendedprice") - 20000).alias("db"))


@query("apply_offsets", f"""SELECT plot_id, pass, v + coalesce(off, 0) AS v FROM ({B.OBS}) o LEFT JOIN
(SELECT {B.SLOT} AS pass, max(value) - 400 AS off FROM events WHERE event_type = 'signup' AND day(ts) <= 25 GROUP BY 1) f
USING (pass)""", f="v")
def _(t):
    off = t.events.where("event_type = 'signup' and dayofmonth(ts) <= 25").groupBy(B.slot().alias("pass")).agg(
        (F.max("value") - 400).alias("offset"))
    return series.apply_offsets(B.obs(t), off).select("plot_id", "pass", "v")


BANDS = """SELECT l_orderkey, l_linenumber, (l_linenumber + 1)::INTEGER AS cls, l_quantity - 3 AS red,
l_extendedprice / 2000.0 - 2 AS nir FROM lineitem"""


def bands(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + 1).cast("int").alias("cls"),
                             (F.col("l_quantity") - 3).alias("red"),
                             (F.col("l_extendedprice") / 2000.0 - 2).alias("nir"))


VALID = "cls IN (4, 5, 6, 7) AND red > 0 AND nir > 0"


@query("validity_mask", f"SELECT l_orderkey, l_linenumber, ({VALID}) AS valid FROM ({BANDS}) b")
def _(t):
    return bands(t).select("l_orderkey", "l_linenumber",
                           X.valid_cell(F.col("cls"), F.col("red"), F.col("nir")).alias("valid"))


@query("normalized_difference", f"""SELECT l_orderkey, l_linenumber, CASE WHEN {VALID} AND nir + red > 0
THEN (nir - red) / (nir + red) END AS nd FROM ({BANDS}) b""", f="nd")
def _(t):
    ok = X.valid_cell(F.col("cls"), F.col("red"), F.col("nir"))
    return bands(t).select("l_orderkey", "l_linenumber",
                           X.normalised_difference(F.col("nir"), F.col("red"), ok).alias("nd"))


@query("mosaic_first_nonzero", """SELECT l_suppkey AS r, l_partkey AS c, arg_min(v, o) AS value, min(o) AS src_order
FROM (SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS o, l_extendedprice - 5000 AS v FROM lineitem) s
WHERE v > 0 GROUP BY 1, 2""", f="value")
def _(t):
    src = t.lineitem.select(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c"),
                            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src_order"),
                            (F.col("l_extendedprice") - 5000).alias("value"))
    return zonal.mosaic(src)


DRIFT = f"SELECT pass, avg(v) / 50 AS drift_db FROM ({B.OBS}) o GROUP BY 1"


def drift(t):
    return B.obs(t).groupBy("pass").agg((F.avg("v") / 50).alias("drift_db"))


@query("departure", f"""SELECT plot_id, pass, v - (avg(v - drift_db) FILTER (pass IN (0, 1)) OVER (PARTITION BY plot_id)
+ drift_db) AS departure FROM ({B.OBS}) o JOIN ({DRIFT}) d USING (pass)""", f="departure")
def _(t):
    return series.departure(B.obs(t), drift(t), (0, 1)).select("plot_id", "pass", "departure")


@query("departure_simple", f"""SELECT plot_id, pass, v - avg(v) FILTER (rn <= 2) OVER (PARTITION BY plot_id) AS departure
FROM (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY doy) AS rn FROM ({B.FULL}) f) x""", f="departure")
def _(t):
    return series.departure_first_k(B.full(t), 2).select("plot_id", "pass", "departure")


@query("clip_signed", f"SELECT plot_id, pass, greatest(departure, 0) AS depth, departure AS signed FROM ({B.DEP}) d", f="depth signed")
def _(t):
    d = F.col("departure")
    return B.dep(t).select("plot_id", "pass", X.clip_pos(d).alias("depth"), X.signed(d).alias("signed"))


T6 = "SELECT plot_id, " + ", ".join(
    f"max(v) FILTER (pass = {i}) AS t{i + 1}" for i in range(6)) + f" FROM ({B.OBS}) o GROUP BY 1"


@query("trajectory_features", f"""SELECT plot_id, (t3 - t1) / 10 AS slope_early, (t4 - t3) / 5 AS slope_late,
(t2 - t1) / 5 AS slope_emerge, t1 - 2 * t3 + t4 AS curvature, least(t1, t2) - t3 AS flood_depth,
greatest(t1, t2, t3, t4, t5, t6) - least(t1, t2, t3, t4, t5, t6) AS dynamic_range,
list_position([t1, t2, t3, t4, t5, t6], greatest(t1, t2, t3, t4, t5, t6)) - 1 AS peak_idx,
(t1 + t2 + t3 + t4 + t5 + t6) / 6 AS mean_level, (t1 / 2 + t2 + t3 + t4 + t5 + t6 / 2) * 5 / 25 AS auc,
(t6 - t4) / 10 AS slope_harvest, t4 - t6 AS late_drop, t6 AS end_level, t6 - greatest(t1, t2) AS end_departure
FROM ({T6}) t WHERE t1 + t2 + t3 + t4 + t5 + t6 IS NOT NULL""", f="slope_early slope_late slope_emerge curvature flood_depth dynamic_range mean_level auc slope_harvest late_drop end_level end_departure", cast="peak_idx:BIGINT")
def _(t):
    return series.trajectory_features(series.complete_on(B.obs(t), 6), range(6), B.DOYS)


@query("outlier_screen", f"""SELECT plot_id, max(v) FILTER (pass <> 4) > 150 AS too_bright, max(v / 100) FILTER (pass <> 4) > 1.6 AS too_spiky,
min(departure) FILTER (pass IN (2, 3, 5)) >= 0.5 AS long_duration_flag,
coalesce(max(v) FILTER (pass <> 4) > 150, false) OR coalesce(max(v / 100) FILTER (pass <> 4) > 1.6, false)
OR coalesce(min(departure) FILTER (pass IN (2, 3, 5)) >= 0.5, false) AS screened FROM ({B.DEP}) d GROUP BY 1""")
def _(t):
    d = B.dep(t).withColumn("cov", F.col("v") / 100)
    return series.outlier_screen(d, (0, 1, 2, 3, 5), (2, 3, 5), 150.0, 1.6, 0.5)


@query("map_constant", f"SELECT plot_id, {B.sql_map(B.REFERENCE)} AS reference FROM ({B.PLOTS}) p", f="reference")
def _(t):
    return B.plots(t).select("plot_id", X.lookup(F.col("cls"), B.REFERENCE, "reference").alias("reference"))


@query("threshold_label", f"""SELECT plot_id, coalesce(CASE WHEN t3 >= 60 AND t4 - t3 <= 0 THEN 'first' WHEN t4 - t3 >= 10 THEN 'second' END,
CASE WHEN t6 >= 55 THEN 'third' END) AS cls FROM ({T6}) t""")
def _(t):
    w = B.obs(t).groupBy("plot_id").agg(*[series.at_pass(i).alias(f"t{i + 1}") for i in (2, 3, 5)])
    a, b = F.col("t3"), F.col("t4") - F.col("t3")
    first = X.rule_label([((a >= 60) & (b <= 0), "first"), (b >= 10, "second")])
    return w.select("plot_id", F.coalesce(first, X.rule_label([(F.col("t6") >= 55, "third")])).alias("cls"))


ZV = "SELECT plot_id, cluster, " + ", ".join(
    f"(e{i} - avg(e{i}) FILTER (cluster < 8) OVER ()) / nullif(stddev_pop(e{i}) FILTER (cluster < 8) OVER (), 0) AS e{i}"
    for i in range(B.ELEMENTS)) + f" FROM ({B.VECTORS}) v"


@query("zscore", ZV, f=" ".join(B.DIMS))
def _(t):
    return rollup.zscore(B.vectors(t), B.DIMS, F.col("cluster") < 8)


PROFILE = "SELECT cluster, " + ", ".join(f"avg(e{i}) AS e{i}" for i in range(B.ELEMENTS)) + f" FROM ({B.VECTORS}) v GROUP BY 1"
ZPROFILE = "SELECT cluster, " + ", ".join(
    f"(e{i} - avg(e{i}) OVER ()) / nullif(stddev_pop(e{i}) OVER (), 0) AS e{i}" for i in range(B.ELEMENTS)) + f" FROM ({PROFILE}) p"
# Fixed values of the binding: rule coefficients per class.
RULES = {"A": {"e0": 1.0, "e1": 0.6, "e2": -0.3}, "B": {"e2": 1.0, "e3": -0.4}, "C": {"e4": -1.0, "e5": 0.5}}


@query("cluster_profile", ZPROFILE, f=" ".join(B.DIMS))
def _(t):
    from fieldspark.operators.cluster import cluster_profile
    return cluster_profile(B.vectors(t), B.DIMS)


@query("rule_scores", " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS cls, {' + '.join(f'{w} * {f}' for f, w in r.items())} AS score FROM ({ZPROFILE}) z"
    for c, r in RULES.items()), f="score")
def _(t):
    from fieldspark.operators.cluster import cluster_profile, rule_scores
    return rule_scores(cluster_profile(B.vectors(t), B.DIMS), RULES)


QUALITY = f"""SELECT plot_id, n_valid, CASE WHEN n_valid = 6 THEN 'measured' WHEN n_valid >= 4 THEN 'interpolated' ELSE 'imputed' END
AS data_quality FROM (SELECT plot_id, count(*) FILTER (v IS NOT NULL AND coalesce(n, 0) / 4.0 >= 0.5) AS n_valid
FROM (SELECT f.*, g.n FROM ({B.FULL}) f LEFT JOIN ({B.GAPS}) g USING (plot_id, pass)) x GROUP BY 1) y"""


def with_coverage(t):
    n = B.gaps(t).select("plot_id", "pass", "n")
    return B.full(t).join(n, ["plot_id", "pass"], "left").withColumn(
        "coverage", F.coalesce("n", F.lit(0)) / 4.0)


@query("quality_flag", QUALITY)
def _(t):
    return series.count_valid(with_coverage(t), 6, 4)


@query("round_then_derive", f"""SELECT plot_id, weight, value, round(value * weight, 4) AS production FROM
(SELECT plot_id, round(weight, 2) AS weight, round(value, 2) AS value FROM (SELECT plot_id, weight, value * 1.0037 AS value FROM ({B.PLOTS}) p) a) b""",
       f="weight value production", nd=4)
def _(t):
    p = B.plots(t).withColumn("value", F.col("value") * 1.0037)
    return rollup.round_shipped(p, ["weight", "value"], 2).select(
        "plot_id", "weight", "value", F.round("production", 4).alias("production"))


@query("project_exact", f"SELECT plot_id, cls, weight, value FROM ({B.PLOTS}) p ORDER BY plot_id", f="value")
def _(t):
    return rollup.plot_table(B.plots(t), ["plot_id", "cls", "weight", "value"])


@query("fold_angle", """SELECT o_orderkey, abs(((az - 318.4 + 90) % 180 + 180) % 180 - 90) AS delta, cos(radians(2 * (az - 318.4))) AS c2
FROM (SELECT o_orderkey, o_totalprice % 180 AS az FROM orders) a""", f="delta c2")
def _(t):
    az = F.col("o_totalprice") % 180
    return t.orders.select("o_orderkey", X.folded_angle(az, 318.4).alias("delta"),
                           X.cos_double_angle(az, 318.4).alias("c2"))


_CH = " ".join(f", max(CASE WHEN pass = {p} THEN s END) AS c{i + 1}" for i, p in enumerate((1995, 1996, 1997)))


@query("channel_stretch", f"""SELECT r, c, """ + ", ".join(f"CASE WHEN n = 3 THEN c{i} ELSE 0 END AS ch{i}" for i in (1, 2, 3)) + f"""
FROM (SELECT r, c, count(*) AS n {_CH} FROM (SELECT r, c, pass, greatest(0, least(1, (db - median(db) OVER (PARTITION BY pass) + 1) / 2)) AS s
FROM (SELECT r, c, pass, 10 * log10(value) + CASE WHEN pass = 1996 THEN 0.5 ELSE 0 END AS db FROM ({B.GRID}) g WHERE pass IN (1995, 1996, 1997)) d) e GROUP BY 1, 2) f""",
       f="ch1 ch2 ch3")
def _(t):
    return zonal.composite(B.grid(t), (1995, 1996, 1997), {1996: 0.5}, half_width=1.0)


@query("grid_window_filter", f"SELECT pass, r, c, value FROM ({B.GRID}) g WHERE r BETWEEN 20 AND 59 AND c BETWEEN 2 AND 5", f="value")
def _(t):
    win = {"x_min": 102.0, "x_max": 106.0, "y_min": 440.0, "y_max": 480.0}
    return zonal.grid_slice(B.grid(t), win, x_min=100.0, y_max=500.0).select("pass", "r", "c", "value")


@query("unpivot_dates", f"SELECT plot_id, 'vh' AS band, (DATE '2024-01-03' + (pass * 5)::INTEGER) AS d, (pass * 5 + 3)::INTEGER AS doy, v FROM ({B.FULL}) f", f="v")
def _(t):
    wide = B.gaps(t).groupBy("plot_id").agg(*[
        series.at_pass(i).alias(f"vh_2024-01-{5 * i + 3:02d}") for i in range(6)])
    return series.unpivot_dates(wide)


@query("histogram", f"""SELECT least(floor((value - 0.9) / 0.08)::INTEGER, 24) AS bin, count(*) AS n FROM ({B.PLOTS}) p
WHERE value BETWEEN 0.9 AND 2.9 GROUP BY 1""")
def _(t):
    return rollup.histogram(B.plots(t), "value", 0.9, 2.9, 25)


@query("polygon_measures", f"""SELECT plot_id, 4 * hx * hy AS area, 4 * (hx + hy) AS perimeter, cx, cy,
least(4.0, 0.25 * hx * hy / (hx + hy)) AS erode FROM ({B.RECT}) r""", f="area perimeter cx cy erode")
def _(t):
    return geometry.polygon_measures(B.rectangles(t))
