"""Weighted rollups, summaries and audits over plot tables
``plots(plot_id, cls, weight, value, ...)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.expr import close_to, spaced_bin
from fieldspark.operators.ordered import (attach, join_stats, null_safe_join, quantiles,
                                          quantiles_of)
from fieldspark.sources.stage import materialise

ALL = "ALL"


def with_total(df: DataFrame, key: str = "cls") -> DataFrame:
    """Every row once under its own class and once under ALL.

    The copies meet again in the map-side partial aggregate, so what is shuffled is one row per
    class and task.
    """
    return df.withColumn(key, F.explode(F.array(F.col(key), F.lit(ALL))))


def weighted_mean(value: str, weight: str = "weight") -> Column:
    """Weighted mean over rows that have both; null when the weight is zero."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.try_divide(F.sum(F.when(both, F.col(value) * F.col(weight))),
                        F.sum(F.when(both, F.col(weight))))


def weighted_rollup(plots: DataFrame) -> DataFrame:
    """Per class and overall: count, weight and its share, weighted mean, p10/p90, production,
    weighted fraction and the weight share of high-confidence plots. ALL has no reference."""
    rows = with_total(plots)
    high = F.when(F.col("confidence") == "high", F.col("weight")).otherwise(0.0)
    agg = rows.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"),
        F.max("reference").alias("reference"),
        weighted_mean("value").alias("value_wt"), F.sum("production").alias("production"),
        weighted_mean("fraction").alias("fraction_wt"),
        F.try_divide(F.sum(high), F.sum("weight")).alias("high_share"))
    agg = agg.withColumn("reference", F.when(F.col("cls") != ALL, F.col("reference")))
    agg = attach_total_share(materialise(agg))
    return agg.join(quantiles(rows, ["cls"], "value", {"value_p10": 0.1, "value_p90": 0.9}), "cls", "left")


def attach_total_share(agg: DataFrame) -> DataFrame:
    whole = agg.where(F.col("cls") == ALL).agg(F.max("weight").alias("_all"))
    return null_safe_join(agg, whole, []).withColumn(
        "weight_share", F.try_divide(F.col("weight"), F.col("_all"))).drop("_all")


def zone_rollup(plots: DataFrame, size: float = 500.0, min_plots: int = 5) -> DataFrame:
    """Square zones counted from the smallest coordinates, ascending by weighted mean.

    The key is (zx, zy): a label of two joined indices would be ambiguous from ten zones on.
    """
    z = attach(plots, [], {"_x0": F.min("x"), "_y0": F.min("y")}).withColumns({
        "zx": F.floor((F.col("x") - F.col("_x0")) / size),
        "zy": F.floor((F.col("y") - F.col("_y0")) / size)})
    key = ["zx", "zy"]
    per_class = z.groupBy(*key, "cls").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"),
        F.sum(F.col("weight") * F.col("value")).alias("wv"), F.sum("production").alias("p"),
        F.count_if(F.col("data_quality") == "measured").alias("m"))
    out = per_class.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("w").alias("weight"),
        F.try_divide(F.sum("wv"), F.sum("w")).alias("value_wt"), F.sum("p").alias("production"),
        F.min_by("cls", F.struct(-F.col("w"), F.col("cls"))).alias("dominant"),
        (F.sum("m") / F.sum("n")).alias("measured_share")).where(F.col("n") >= min_plots)
    med = quantiles(z, key, "fraction", {"fraction_median": 0.5})
    return out.join(med, key, "left").orderBy("value_wt", *key)


def mode_low(df: DataFrame, by: Sequence[str], column: str, out: str = "mode") -> DataFrame:
    """Most frequent category per group; ties go to the smallest."""
    n = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(out))


def quantile_summary(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    ends = df.groupBy(*by).agg(
        *[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])
    return null_safe_join(ends, quantiles_of(
        df, by, columns, {"p10": 0.1, "p50": 0.5, "p90": 0.9}), list(by))


def degenerate_share(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Share of each class that sits on its own median, which no rank can order."""
    med = quantiles_of(df, [by], columns, {"med": 0.5})
    joined = join_stats(df, med, [by])
    return joined.groupBy(by).agg(
        *[F.avg(close_to(F.col(c), F.col(f"{c}_med")).cast("double")).alias(f"{c}_on_median")
          for c in columns])


def tie_audit(df: DataFrame, axis: str, weight: str = "weight") -> DataFrame:
    """How much of an ordering is decided by equal keys, before and after clipping at zero."""
    per = df.groupBy(axis).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    tied, low = F.col("n") > 1, F.col(axis) <= 0
    return per.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(tied, F.col("n"))), F.lit(0)).alias("n_tied"),
        F.coalesce(F.sum(F.when(tied, F.col("w"))), F.lit(0)).alias("weight_tied"),
        F.max("n").alias("largest_run"),
        F.coalesce(F.sum(F.when(low, F.col("n"))), F.lit(0)).alias("n_tied_clipped"),
        F.coalesce(F.sum(F.when(low, F.col("w"))), F.lit(0)).alias("weight_tied_clipped"),
        F.count_if(low).alias("n_distinct_clipped"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    b = spaced_bin(F.col(column), lo, hi, bins)
    return (df.select(b.alias("bin")).where("bin is not null").groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n")))


def season_anomaly(daily: DataFrame, year: int, baseline: tuple[int, int],
                   months: Sequence[int] = (6, 7, 8, 9, 10, 11)) -> DataFrame:
    """Season total of one year against the mean, sd and median of the baseline years."""
    y = F.year("d")
    totals = (daily.where(F.month("d").isin(*months)).groupBy(y.alias("year"))
              .agg(F.sum("v").alias("total")))
    base = F.when(F.col("year").between(*baseline), F.col("total"))
    out = totals.agg(
        F.max(F.when(F.col("year") == year, F.col("total"))).alias("total"),
        F.avg(base).alias("mean"), F.stddev_samp(base).alias("sd"), F.median(base).alias("median"))
    gap = F.col("total") - F.col("mean")
    return out.withColumns({"anomaly_pct": 100.0 * F.try_divide(gap, F.col("mean")),
                            "z": F.try_divide(gap, F.col("sd"))})


def year_context(series: DataFrame, year: int, span: int = 5, by: str = "cls") -> DataFrame:
    """A year against the mean of the years before it, the last one, and its rank among ``span``."""
    y, v = F.col("year"), F.col("v")
    now = F.max(F.when(y == year, v))
    prior = F.avg(F.when(y < year, v))
    last = F.max(F.when(y == year - 1, v))
    window = series.where(y.between(year - span + 1, year))
    head = window.groupBy(by).agg(
        now.alias("year_v"), prior.alias("prior_mean"),
        (100.0 * F.try_divide(now, prior)).alias("pct_of_prior_mean"),
        (100.0 * (F.try_divide(now, last) - 1.0)).alias("vs_last_year_pct"))
    head = materialise(head)
    ranked = null_safe_join(window, head.select(by, "year_v"), [by]).groupBy(by).agg(
        F.count_if(v <= F.col("year_v")).alias("rank_of_span"))
    return head.join(ranked, by)


def cohort_trajectory(obs: DataFrame, by: Sequence[str] = ("cls", "pass")) -> DataFrame:
    n = obs.groupBy(*by).agg(F.count("v").alias("n"))
    return null_safe_join(n, quantiles(obs, by, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), list(by))


def prior_log_ratio(plots: DataFrame, prior: Mapping[str, float], checked: Sequence[str]) -> DataFrame:
    """log(measured share / prior share) for the classes the prior did not assign."""
    w = plots.groupBy("cls").agg(F.sum("weight").alias("w"))
    shares = attach(w, [], {"_t": F.sum("w")}).where(F.col("cls").isin(*checked))
    entries = [x for k in checked for x in (F.lit(k), F.lit(float(prior[k])))]
    share = F.col("w") / F.col("_t")
    p = F.element_at(F.create_map(*entries), F.col("cls"))
    return shares.select("cls", share.alias("measured_share"), p.alias("prior_share"),
                         F.when(share > 0, F.ln(share / p)).alias("log_ratio"))


def prior_sigma(ratios: DataFrame, fallback: float = 0.5) -> DataFrame:
    return ratios.agg(F.coalesce(F.stddev_samp("log_ratio"), F.lit(fallback)).alias("sigma"))


def extrapolated_summary(df: DataFrame, by: str = "cls", column: str = "fraction") -> DataFrame:
    head = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean_fraction"),
        F.count_if(F.col(column) < 0.01).alias("n_observed"))
    return null_safe_join(head, quantiles(df, [by], column, {"p90_fraction": 0.9}), [by])


def separability(df: DataFrame, by: str = "cls", early: str = "early", late: str = "late") -> DataFrame:
    """Spread of class means, the speckle floor, low-margin plots and the early rise."""
    spread = df.groupBy(by).agg(F.avg("value").alias("m")).agg(
        (F.max("m") - F.min("m")).alias("class_spread"))
    low = df.agg(F.count_if(F.col("margin") < 0.05).alias("n_low_margin"),
                 F.count(F.lit(1)).alias("n"))
    rise = df.withColumn("_r", F.col(late) - F.col(early))
    med = quantiles_of(rise.withColumnRenamed("_r", "rise"), [], ["cells", "rise"], {"med": 0.5})
    out = null_safe_join(null_safe_join(spread, low, []), med, [])
    return out.select("class_spread", (4.34 / F.sqrt("cells_med")).alias("speckle_floor_db"),
                      "n_low_margin", "n", F.col("rise_med").alias("median_rise"))


def null_ablation(plots: DataFrame) -> DataFrame:
    """Total with and without the modulation, and how far single plots move."""
    moved = F.try_divide(F.abs(F.col("value") - F.col("reference")), F.col("reference"))
    d = plots.withColumn("moved", moved)
    head = d.agg(
        F.sum(F.col("value") * F.col("weight")).alias("total"),
        F.sum(F.col("reference") * F.col("weight")).alias("null_total"),
        F.count_if(F.col("moved") > 0.05).alias("n_moved_5pct"))
    q = quantiles(d, [], "moved", {"median_move": 0.5, "p90_move": 0.9})
    return null_safe_join(head, q, []).withColumn(
        "diff_pct", 100.0 * F.try_divide(F.col("total") - F.col("null_total"), F.col("null_total")))


def coverage_table(df: DataFrame, limit: float = 0.6) -> DataFrame:
    return df.groupBy("data_quality").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("coverage") >= limit).alias("n_covered"))


def tally(ledger: DataFrame, verdicts: Sequence[str], column: str = "verdict") -> DataFrame:
    """Counts per verdict in one row, derived from the entries."""
    v = F.col(column)
    return ledger.agg(*[F.count_if(v == x).alias(x.replace(" ", "_")) for x in verdicts],
                      F.count(F.lit(1)).alias("n"))


def label_agreement(a: DataFrame, b: DataFrame, key: str = "plot_id", by: Sequence[str] = ()) -> DataFrame:
    """Agreement of two labelings, overall and where both are confident, with weights; of ``a`` with
    each group of ``by`` in ``b``."""
    r = b.select(*by, key, F.col("cls").alias("_b"), F.col("confidence").alias("_cb"))
    j = a.join(r, key)
    same = (F.col("cls") == F.col("_b")).cast("double")
    sure = (F.col("confidence") == "high") & (F.col("_cb") == "high")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(same).alias("agreement"),
        F.count_if(sure).alias("n_sure"), F.avg(F.when(sure, same)).alias("agreement_sure"),
        F.sum(F.when(same == 1, F.col("weight")).otherwise(0)).alias("weight_same"),
        F.sum("weight").alias("weight"))


def plot_table(df: DataFrame, columns: Sequence[str], key: str = "plot_id") -> DataFrame:
    """Fixed ordered projection, ordered by key."""
    return df.select(*columns).orderBy(key)


def round_shipped(df: DataFrame, columns: Sequence[str], places: int = 4, value: str = "value",
                  weight: str = "weight", product: str = "production") -> DataFrame:
    """Round the shipped columns first, then derive the product from the rounded ones."""
    out = df.withColumns({c: F.round(c, places) for c in columns})
    return out.withColumn(product, F.round(F.col(value) * F.col(weight), places))


def centred_factor(df: DataFrame, x: str, by: Sequence[str], span: float | Column,
                   out: str = "factor") -> DataFrame:
    """Factor that is exactly 1 at the group median, 1 - span at p05 and 1 + span at p95.

    Piecewise linear and clipped; a side of zero width contributes nothing.
    """
    q = quantiles(df, by, x, {"_lo": 0.05, "_mid": 0.5, "_hi": 0.95})
    d = join_stats(df, q, list(by))
    v = F.col(x)

    def side(num: Column, den: Column) -> Column:
        part = F.try_divide(num, den)
        return F.coalesce(F.when(part < 0, 0.0).when(part > 1, 1.0).otherwise(part), F.lit(0.0))

    span = F.lit(float(span)) if isinstance(span, (int, float)) else span
    up = side(v - F.col("_mid"), F.col("_hi") - F.col("_mid"))
    down = side(F.col("_mid") - v, F.col("_mid") - F.col("_lo"))
    return d.withColumn(out, 1.0 + span * up - span * down).drop("_lo", "_mid", "_hi")


def group_residual(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    return attach(df, by, {"group_mean": F.avg(x)}).withColumn(
        "residual", F.col(x) - F.col("group_mean"))


def zscore(df: DataFrame, columns: Sequence[str], fit: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Standardise by mean and population sd of the rows that ``fit``, within ``by``; a zero sd
    counts as 1."""
    def of(c: str) -> Column:
        return F.col(c) if fit is None else F.when(fit, F.col(c))

    aggs = {}
    for c in columns:
        aggs[f"_m_{c}"] = F.avg(of(c))
        aggs[f"_s_{c}"] = F.stddev_pop(of(c))
    d = attach(df, list(by), aggs)
    return d.withColumns({
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        for c in columns}).drop(*aggs)


def pick_scene(items: DataFrame, validity: DataFrame, required: Sequence[str],
               max_cloud: float = 80.0, min_valid: float = 0.80) -> DataFrame:
    """Per window the least cloudy date that is valid enough; a required window without one fails.

    Items of a date are averaged (a missing cloud value counts as 100), dates above the cloud
    limit are skipped, and equal clouds take the earlier date.
    """
    cloud = (items.withColumn("_c", F.coalesce("cloud", F.lit(100.0)))
             .groupBy("window", "d").agg(F.avg("_c").alias("cloud"), F.count(F.lit(1)).alias("n_items"))
             .where(F.col("cloud") <= max_cloud))
    ok = cloud.join(validity, ["window", "d"]).where(F.col("valid_share") >= min_valid)
    best = ok.groupBy("window").agg(F.min(F.struct("cloud", "d", "n_items", "valid_share")).alias("_b"))
    found = best.select("window", F.col("_b.d").alias("d"), F.col("_b.cloud").alias("cloud"),
                        F.col("_b.n_items").alias("n_items"), F.col("_b.valid_share").alias("valid_share"))
    seen = items.select("window").distinct()
    if len(required):
        kind = items.schema["window"].dataType.simpleString()
        seen = seen.union(items.sparkSession.createDataFrame([(x,) for x in required], f"window {kind}")).distinct()
    windows = seen.join(found, "window", "left")
    checked = F.when(F.col("d").isNull() & F.col("window").isin(*required), F.raise_error(
        F.concat(F.lit("no usable date for "), F.col("window").cast("string"))).cast("date")
    ).otherwise(F.col("d"))
    return windows.withColumn("d", checked).where(F.col("d").isNotNull())


def rank_sensitivity(totals: DataFrame, key: str, base: str, total: str = "total") -> DataFrame:
    """Scenarios ordered by how far their total lies from the base scenario's, widest first.

    A scenario table has a few rows, so ranking it in one window is bounded by design.
    """
    from pyspark.sql import Window
    ref = totals.where(F.col(key) == base).agg(F.max(total).alias("_base"))
    d = null_safe_join(totals, ref, []).withColumn("half_width", F.abs(F.col(total) - F.col("_base"))).drop("_base")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("half_width").desc(), key)
    return d.withColumn("place", F.row_number().over(w)).orderBy("place")


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def schema_difference(df: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """Categories present but not expected, and expected but absent."""
    have = df.select(F.col(column).alias("item")).distinct()
    want = expected.select(F.col(column).alias("item")).distinct()
    return (have.join(want, "item", "left_anti").withColumn("kind", F.lit("extra"))
            .unionByName(want.join(have, "item", "left_anti").withColumn("kind", F.lit("missing"))))


def dates_between(dates: DataFrame, span: DataFrame, column: str = "d") -> DataFrame:
    """Distinct dates inside the span (one row: lo, hi), ascending."""
    return (null_safe_join(dates.select(column).distinct(), span, [])
            .where(F.col(column).between(F.col("lo"), F.col("hi"))).select(column).orderBy(column))
