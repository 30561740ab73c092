"""End-to-end jobs: operators chained, staged at the edges where a result is used twice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.expr import cos_double_angle, folded_angle, lookup, to_db
from fieldspark.operators import cluster as C
from fieldspark.operators import gates, joins, knn, ordered, resample, rollup, series, stats, zonal
from fieldspark.sources.stage import materialise


def job_features(cells: DataFrame, plots: DataFrame, doys: Mapping, offsets: DataFrame,
                 min_valid: int = 4, k: int = 8, line: tuple | None = None) -> DataFrame:
    """Cells to a complete level trajectory per plot and pass, with its quality.

    ``cells(plot_id, pass, value)`` are already joined with their plots;
    ``plots(plot_id, x, y, core_cells)`` carries the centroid. Every plot comes back with every
    pass; one that no cell covers is filled from its neighbours like any other. Steps: zonal aggregation, decibel
    and offsets, quality, gap fill from the plot itself, fill from the nearest donors, and the
    replacement of one odd pass by the line through two others.
    """
    z = zonal.zonal_stats(cells, plots.select("plot_id", "core_cells"))
    z = z.withColumn("v", to_db(F.col("mean")))
    z = materialise(series.apply_offsets(z, offsets).select("plot_id", "pass", "v", "coverage", "cov"))
    days = F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), F.lit(float(d)).alias("doy")) for p, d in doys.items()]))
    full = plots.select("plot_id", days.alias("_s")).select("plot_id", "_s.*").join(z, ["plot_id", "pass"], "left")
    quality = series.count_valid(full, len(doys), min_valid)
    usable = full.withColumn("v", F.when(F.col("coverage") >= 0.5, F.col("v")))
    filled = series.gap_fill(usable, min_valid).drop("n_valid")
    filled = materialise(filled.join(quality, "plot_id").withColumn("v", F.col("filled")))
    need = filled.where("data_quality = 'imputed'").select("plot_id").distinct()
    donors = plots.join(need, "plot_id", "left_anti").select(F.col("plot_id").alias("donor_id"), "x", "y")
    wanted = plots.join(need, "plot_id", "left_semi").select(F.col("plot_id").alias("query_id"), "x", "y")
    if wanted.isEmpty():
        done = filled.withColumn("donor_dist", F.lit(None).cast("double"))
    else:
        near = knn.knn_join(wanted, knn.donor_gate(donors, k), k)
        done = series.impute_knn(filled, need, near, ["v", "cov"])
    done = done.select("plot_id", "pass", "doy", "v", "cov", "n_valid", "data_quality", "donor_dist")
    if line is None:
        return done
    left, mid, right = line
    anomaly = series.line_anomaly(done, mid, left, right).select("plot_id", "line", "anomaly")
    return done.join(anomaly, "plot_id", "left").withColumn(
        "v", F.when(F.col("pass") == mid, F.col("line")).otherwise(F.col("v"))).drop("line")


def job_phenology(obs: DataFrame, drift: DataFrame, anchors: Sequence, canopy: Sequence,
                  min_episode: float = series.MIN_EPISODE) -> DataFrame:
    """Trajectories to canopy measures: departure, peak, end, integral, clearing."""
    dep = materialise(series.departure(obs, drift, anchors))
    season = dep.where(F.col("pass").isin(*canopy))
    out = series.peak(season, min_episode).join(series.cleared(season, min_episode), "plot_id")
    integral = series.trapezoid(season, value=F.col("departure"), mean=True)
    wide = dep.groupBy("plot_id").agg(*[
        series.at_pass(p, "departure").alias(f"departure_{p}") for p in [*anchors, *canopy]])
    return out.join(integral, "plot_id").join(wide, "plot_id")


def job_labels(frame: DataFrame, columns: Sequence[str], axis: str, prior: Sequence[float],
               labels: Sequence[str], runs: DataFrame | None = None, k: int = 9,
               seeds: Sequence[int] = tuple(range(20)), inits: int = 10, level: str = "level_T3", drop: str = "d34",
               end: str = "canopy_end", end_min: float = 1.5, first: str = "Rice",
               second: str = "Cotton", by: Sequence[str] = ()) -> DataFrame:
    """Descriptors to labels: consensus clusters, clear rules, a per-plot rule, an ordered
    allocation of the rest, and how far each plot is from changing its label.

    ``frame`` holds the descriptors with ``screened``, ``x``, ``y`` and ``weight``. Screened plots
    take their neighbours' cluster and are never confident. ``runs`` may bring the clusterings; with
    ``by`` it holds those of many settings, and the whole chain runs once for all of them.
    """
    by = list(by)
    keep = ~F.col("screened")
    scaled = rollup.zscore(frame, columns, keep).select("plot_id", "screened", *columns)
    if runs is None:
        runs = C.kmeans_runs(scaled.where(keep), columns, k, list(seeds), inits)
    part = materialise(C.consensus_partition(runs, by=by).select(*by, "plot_id", "cluster", "stability"))
    donors = frame.where(keep).select(F.col("plot_id").alias("donor_id"), "x", "y")
    lost = frame.where(F.col("screened")).select(F.col("plot_id").alias("query_id"), "x", "y")
    if lost.isEmpty():
        given = part
    else:
        near = knn.knn_join(lost, donors, 8)
        voted = C.neighbour_label(part.select(*by, "plot_id", "cluster"), near, by=by)
        given = part.unionByName(voted.withColumn("stability", F.lit(0.0)))
    profile = C.cluster_profile(scaled.where(keep).join(part, "plot_id"), columns, by=by)
    tier1 = profile.select(*by, "cluster", C.assign_tier1(profile, level, drop, first, second).alias("_t1"))
    df = frame.join(given, "plot_id").join(tier1, [*by, "cluster"], "left")
    standing = F.when(keep & (F.col(end) >= end_min), F.lit(second))
    df = materialise(df.withColumn("cls", F.coalesce("_t1", standing)).drop("_t1"))
    open_ = df.where("cls is null").drop("cls")
    cut = ordered.share_cut(open_, axis, "plot_id", "weight", prior, labels, by=by, out="cls").drop("cum_share")
    done = df.where("cls is not null").withColumn("tier2", F.lit(False)).unionByName(
        cut.withColumn("tier2", F.lit(True)).select(*df.columns, "tier2"))
    done = materialise(done.withColumn("confidence", F.when(F.col("tier2") | F.col("screened"), "low").otherwise("high")))
    points = scaled.join(done.select(*by, "plot_id", "cluster", "cls"), "plot_id")
    margin = C.cluster_margin(points, columns, fit=keep, by=by).select(*by, "plot_id", "margin")
    return done.join(margin, [*by, "plot_id"])


def label_stability(frame: DataFrame, columns: Sequence[str], axis: str, prior: Sequence[float], labels: Sequence[str],
                    base: tuple[int, int] = (9, 20), settings: Sequence[tuple[int, int]] = ((9, 5), (9, 40), (7, 20), (11, 20)),
                    inits: int = 10, **how) -> DataFrame:
    """(k, seeds, n, agreement, n_sure, agreement_sure, ...): the labels at other cluster counts and
    numbers of seeds against those of ``base``, over all plots and where both are sure.

    A seed's fit belongs to every setting that asks for it; all settings share each job of the chain.
    """
    every = list(dict.fromkeys([base, *settings]))
    most = {k: max(n for j, n in every if j == k) for k, _ in every}
    kept = rollup.zscore(frame, columns, ~F.col("screened")).where(~F.col("screened")).select("plot_id", *columns)
    grid = C.kmeans_grid(kept, columns, {k: range(n) for k, n in most.items()}, inits)
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("seeds")) for k, n in every])
    of = F.explode(F.filter(asked, lambda s: (s["k"] == F.col("k")) & (F.col("seed") < s["seeds"]))).alias("_s")
    runs = materialise(grid.select(of, F.col("seed").alias("run"), "plot_id", "cluster").select("_s.*", "run", "plot_id", "cluster"))
    out = materialise(job_labels(frame, columns, axis, prior, labels, runs=runs, by=["k", "seeds"], **how))
    mine = (F.col("k") == base[0]) & (F.col("seeds") == base[1])
    return rollup.label_agreement(out.where(mine).drop("k", "seeds"), out.where(~mine), by=["k", "seeds"])


def job_forecast(obs: DataFrame, plots: DataFrame, calendar: Mapping, reference: Mapping,
                 bands: Mapping, span: float = 0.30) -> DataFrame:
    """Season integral closed to the calendar, centred factor, forecast, and the band gate."""
    labelled = obs.join(plots.select("plot_id", "cls"), "plot_id")
    closed = materialise(series.season_close(labelled, lookup(F.col("cls"), calendar, "calendar end"), ["cls"]))
    f = rollup.centred_factor(closed, "season_integral", ["cls"], span)
    f = f.withColumn("reference", lookup(F.col("cls"), reference, "reference yield"))
    f = materialise(f.withColumn("value", F.col("reference") * F.col("factor")))
    gates.require(gates.plausible_gate(f, bands).agg(F.sum("n_outside").alias("outside_band")))
    return f


def job_ship(plots: DataFrame, columns: Sequence[str], bands: Mapping, classes: Sequence[str],
             containment: DataFrame | None = None) -> dict[str, DataFrame]:
    """Containment gate, rounding, schema gate, rollup, reconciliation, zones.

    Rounding precedes aggregation, so shipped totals are sums of shipped rows.
    """
    if containment is not None:
        c = containment.select((F.col("n_disagree")).alias("n_disagree"),
                               (F.col("weight_outside") > 1e-6).alias("outside"))
        gates.require(c)
    r = materialise(rollup.round_shipped(plots, ["weight", "value", "fraction", "reference"]))
    table = rollup.plot_table(r, columns)
    gates.column_gate(table, columns)
    gates.require(gates.schema_gate(r, "plot_id", [c for c in columns], "cls", classes, ["fraction"], "value", bands))
    summary = materialise(rollup.weighted_rollup(r))
    gates.require(gates.reconcile_gate(r, summary))
    return {"plots": table, "summary": summary, "zones": rollup.zone_rollup(r)}


def job_backtest(preds: DataFrame, splits: DataFrame, model: str = "flat_hold",
                 draws: int = 2000) -> DataFrame:
    """Scores with bootstrap intervals per predictor, per class, and per horizon, in one table."""
    ok = materialise(stats.complete_rows(preds))
    whole = stats.forecast_scores(ok)
    base = ok.where("predictor = 'persistence'").select(
        "plot_id", (F.col("pred") - F.col("truth")).alias("e_base"))
    errors = ok.select("plot_id", "predictor", (F.col("pred") - F.col("truth")).alias("e_model")).join(base, "plot_id")
    ci = resample.bootstrap_skill(errors, draws, by=["predictor"])
    cols = ["part", "item", "predictor", "n", "rmse", "skill", "ci_lo", "ci_hi"]
    none = F.lit(None).cast("double")
    a = whole.join(ci, "predictor").withColumns({"part": F.lit("all"), "item": F.lit("all")}).select(*cols)
    b = stats.best_predictor(ok, "cls", model).select(
        F.lit("class").alias("part"), F.col("cls").alias("item"), F.col("best").alias("predictor"), "n",
        F.col("model_rmse").alias("rmse"), F.col("model_skill").alias("skill"), none.alias("ci_lo"), none.alias("ci_hi"))
    h = stats.forecast_scores(stats.complete_rows(splits, ["plot_id", "split"]), ["split"]).select(
        F.lit("horizon").alias("part"), F.col("split").alias("item"), "predictor", "n", "rmse", "skill",
        none.alias("ci_lo"), none.alias("ci_hi"))
    return a.unionByName(b).unionByName(h)


def job_validate(frame: DataFrame, points: DataFrame, named: str, look: float, draws: int = 999,
                 min_n: int = 20) -> DataFrame:
    """Reserved-date tests, look-direction controls and spatial autocorrelation of the residual.

    ``frame(plot_id, cls, value, early, reserved, late, flagged, cleared, azimuth, elongation,
    anomaly)``. ``named`` is the class that was expected to top the reserved date before the data
    were seen; it is tested one-sided, from ``min_n`` rows on, whichever class came out on top.
    Flagged plots are held against the rest on three dates, cleared ones against standing ones.
    ``look`` is the sensor's direction in degrees.
    """
    frame = materialise(frame)

    def row(df: DataFrame, test: str, item: Column | str, value: Column | str) -> DataFrame:
        return df.select(F.lit(test).alias("test"), (F.lit(item) if isinstance(item, str) else item).alias("item"),
                         (F.col(value) if isinstance(value, str) else value).alias("value"))

    med = materialise(ordered.quantiles(frame, ["cls"], "reserved", {"m": 0.5}))
    top = med.agg(F.max_by("cls", F.struct("m", "cls")).alias("winner"), F.max("m").alias("value"))
    rows = [row(top, "reserved winner", F.col("winner"), "value")]
    u = stats.mann_whitney(frame, "reserved", F.col("cls") == named, "greater")
    rows.append(row(u, "named class against rest, p", named, F.when(F.col("n1") >= min_n, F.col("p"))))
    dates = F.explode(F.array(*[F.struct(F.lit(d).alias("date"), F.col(d).alias("v")) for d in ("early", "reserved", "late")]))
    long = materialise(frame.select("flagged", dates.alias("_s")).select("flagged", "_s.*"))
    rows.append(row(stats.mann_whitney(long, "v", F.col("flagged"), "greater", ["date"]), "flagged against rest, p", F.col("date"), "p"))
    side = ordered.quantiles(long, ["date", "flagged"], "v", {"m": 0.5})
    rows.append(row(side, "median", F.concat_ws(" ", "date", F.when(F.col("flagged"), "flagged").otherwise("rest")), "m"))
    state = frame.withColumn("state", F.when(F.col("cleared") > 0.8, "cleared").when(F.col("cleared") < 0.2, "standing"))
    rows.append(row(ordered.quantiles(state.where("state is not null"), ["state"], "reserved", {"m": 0.5}), "reserved median", F.col("state"), "m"))
    turned = frame.where("elongation >= 1.5").withColumns({
        "delta": folded_angle(F.col("azimuth"), look), "cos2": cos_double_angle(F.col("azimuth"), look)})
    for column, test in (("delta", "look direction rho"), ("cos2", "look direction cos rho")):
        rho = stats.spearman(turned, column, "anomaly")
        rows.append(row(rho, test, F.when(F.abs("rho") > 0.2, "contaminated").otherwise("clean"), "rho"))
    resid = rollup.group_residual(frame, "value", ["cls"]).select("plot_id", F.col("residual").alias("v"))
    known = points.join(resid.where("v is not null").select("plot_id"), "plot_id", "left_semi")
    edges = materialise(stats.neighbour_weights(known))
    rows.append(row(resample.permutation_morans(resid, edges, draws, where=points.select("plot_id", "x", "y")), "residual autocorrelation", F.col("shown"), "observed"))
    return rollup.stack(*rows)


def job_sign(frame: DataFrame, draws: int = 999) -> DataFrame:
    """Which sign a canopy has: matched and control correlations, change slopes per class, an
    interval from map blocks, the response curve and the clearing check, as (part, item, value).

    ``frame(plot_id, cls, x, y, dep_a, dep_b, opt_a, opt_b, cleared)``.
    """
    f = materialise(frame).withColumns({"d_dep": F.col("dep_b") - F.col("dep_a"), "d_opt": F.col("opt_b") - F.col("opt_a")})
    c = stats.matched_control(f, [("a", "dep_a", "opt_a"), ("b", "dep_b", "opt_b"), ("control", "dep_a", "opt_b")])
    rows = [c.select(F.lit("same date").alias("part"), F.col("test").alias("item"), F.col("rho").alias("value"))]
    d = stats.diff_regression(f, "d_opt", "d_dep")
    rows.append(d.select(F.lit("slope").alias("part"), F.col("cls").cast("string").alias("item"), F.col("slope").alias("value")))
    b = resample.block_bootstrap(f, "d_dep", "d_opt", draws)
    rows += [b.select(F.lit("blocks").alias("part"), F.lit(n).alias("item"), F.col(n).alias("value")) for n in ("lo", "rho", "hi")]
    r = stats.quantile_response(f, "opt_a", "dep_a", 6)
    rows.append(r.select(F.lit("response").alias("part"), F.col("bin").cast("string").alias("item"), F.col("y_mean").alias("value")))
    q = stats.qcut_medians(f, "cleared", ["d_opt"], 5)
    rows.append(q.select(F.lit("clearing").alias("part"), F.col("bin").cast("string").alias("item"), F.col("d_opt_median").alias("value")))
    return rollup.stack(*rows)


def job_scene_diagnostics(cells: DataFrame, passes: int, master, select: Sequence, holdout: Sequence,
                          skip: Sequence = (), factor: int = 8, percentile: float = 99.9,
                          apply_min: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Offsets per pass from stable targets, and the spread of the held-out passes.

    Blocks of cells valid on all passes are staged once and read by every step.
    """
    blocks = materialise(zonal.full_blocks(cells, factor, passes))
    targets = materialise(zonal.stable_targets(blocks, select, percentile))
    offsets = materialise(zonal.pass_offsets(blocks, targets, master, skip, apply_min))
    return offsets, zonal.holdout_spread(blocks, targets, offsets, holdout)


def job_season_context(daily: DataFrame, yearly: DataFrame, events: DataFrame, year: int,
                       baseline: tuple[int, int]) -> DataFrame:
    """Season anomaly, antecedent rain of each event day and each class's year, as one table."""
    a = rollup.season_anomaly(daily, year, baseline)
    rows = [a.select(F.lit("season").alias("part"), F.lit(n).alias("item"), F.col(n).alias("value"))
            for n in ("total", "mean", "sd", "median", "anomaly_pct", "z")]
    e = series.antecedent(events, daily)
    rows.append(e.select(F.lit("api").alias("part"), F.col("d").cast("string").alias("item"), F.col("api").alias("value")))
    y = rollup.year_context(yearly, year)
    rows.append(y.select(F.lit("year").alias("part"), F.col("cls").alias("item"), F.col("pct_of_prior_mean").alias("value")))
    return rollup.stack(*rows)


def job_optical(items: DataFrame, validity: DataFrame, bands: DataFrame, labels: DataFrame,
                factor: int, max_cloud: float = 80.0, min_valid: float = 0.80,
                required: Sequence = ()) -> DataFrame:
    """Pick a date per window, mosaic its tiles band by band, take the index on the coarse grid,
    carry index and mask to the fine grid, and average per plot.

    ``bands(window, d, r, c, src_order, cls, red, nir)``; ``labels(r, c, plot_id)`` is fine. Every
    plot has a row for every window that has a scene: without cover its mean is null and its share
    0. A window of ``required`` without a scene fails the job. The index is computed before
    resampling, so one coarse grid is carried instead of four bands.
    """
    from fieldspark.functions.expr import normalised_difference, valid_cell
    chosen = materialise(rollup.pick_scene(items, validity, list(required), max_cloud, min_valid).select("window", "d"))
    used = bands.join(chosen, ["window", "d"])
    # Each band's first tile with a value, whatever the other bands hold there.
    tile = used.groupBy("window", "r", "c").agg(*[
        F.min_by(F.when(F.col(b) > 0, F.col(b)), F.when(F.col(b) > 0, F.col("src_order"))).alias(b)
        for b in ("cls", "red", "nir")])
    ok = valid_cell(F.col("cls"), F.col("red"), F.col("nir"))
    index = tile.select("window", "r", "c", normalised_difference(F.col("nir"), F.col("red"), ok).alias("value"))
    index = materialise(index)
    cells = labels.groupBy("plot_id").agg(F.count(F.lit(1)).alias("core_cells"))
    mean = joins.carry_index(index, labels, factor).groupBy("plot_id", "window").agg(
        F.avg("value").alias("mean"), F.count("value").alias("_n"))
    # Windows are a few dates of one campaign.
    windows = materialise(chosen.agg(F.sort_array(F.collect_set("window")).alias("_w")))
    frame = ordered.null_safe_join(cells, windows, []).select("plot_id", "core_cells", F.explode("_w").alias("window"))
    return frame.join(mean, ["plot_id", "window"], "left").select(
        "plot_id", "window", "mean", F.coalesce(F.col("_n") / F.col("core_cells"), F.lit(0.0)).alias("valid_share"))


def job_witness(second: DataFrame, labels: DataFrame, first_change: DataFrame, late: Sequence,
                drop: Sequence) -> DataFrame:
    """A second sensor's verdict: class medians on late dates, and agreement in the change.

    ``second(plot_id, pass, doy, v)``; ``first_change(plot_id, change)`` is the first sensor's;
    ``drop`` are the passes a sparser sampling lacks.
    """
    dep = materialise(series.departure_first_k(second, 2))
    audit = stats.projection_audit(dep, labels, late)
    rows = [audit.select(F.lit("projection").alias("part"), F.col("cls").alias("item"), F.col("change").alias("value"))]
    own = dep.groupBy("plot_id").agg(
        (series.at_pass(late[-1], "departure") - series.at_pass(late[0], "departure")).alias("own"))
    rho = stats.spearman(own.join(first_change, "plot_id"), "own", "change")
    rows.append(rho.select(F.lit("cross sensor").alias("part"), F.lit("rho").alias("item"), F.col("rho").alias("value")))
    a = series.trapezoid(dep, value=F.col("departure"), mean=True).withColumnRenamed("integral", "a")
    b = series.trapezoid(dep.where(~F.col("pass").isin(*drop)), value=F.col("departure"), mean=True).withColumnRenamed("integral", "b")
    s = stats.spearman(a.join(b, "plot_id"), "a", "b")
    rows.append(s.select(F.lit("sampling").alias("part"), F.lit("rho").alias("item"), F.col("rho").alias("value")))
    return rollup.stack(*rows)
