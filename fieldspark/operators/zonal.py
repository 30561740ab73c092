"""Aggregation over cell tables ``cells(pass, r, c, value)`` and block tables
``blocks(pass, br, bc, value)``. Nodata cells are absent or not positive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.expr import from_db, to_db
from fieldspark.operators.ordered import join_stats, null_safe_join, quantiles
from fieldspark.sources.stage import materialise

FLOOR_POWER = 1e-12


def measured(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("value") > 0)


def zonal_stats(cells: DataFrame, core: DataFrame | None = None, zone: str = "plot_id") -> DataFrame:
    """Per zone and pass: count, mean, variance, variation, looks, and coverage of the core.

    With ``core`` (zone, core_cells) every zone in it has a row for every pass that occurs; where
    it has no cell, count and coverage are 0 and the rest is null. Only count, sum and sum of squares travel, so every map task sends one row per zone and pass.
    """
    v = F.col("value")
    n, s, sq = F.count(F.lit(1)), F.sum(v), F.sum(v * v)
    sums = measured(cells).groupBy(zone, "pass").agg(n.alias("n"), s.alias("_s"), sq.alias("_q"))
    mean = F.col("_s") / F.col("n")
    var = F.when(F.col("n") > 1, F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0)))
    out = sums.withColumns({"mean": mean, "var": var}).withColumns({
        "cov": F.when(F.col("mean") > 0, F.sqrt("var") / F.col("mean")),
        "enl": F.when(F.col("var") > 0, F.col("mean") * F.col("mean") / F.col("var"))})
    out = out.drop("_s", "_q")
    if core is None:
        return out
    # Passes are dates of one campaign: a handful, whatever the number of cells.
    passes = materialise(out.agg(F.sort_array(F.collect_set("pass")).alias("_passes")))
    frame = null_safe_join(core.select(zone, "core_cells"), passes, []).select(
        zone, "core_cells", F.explode("_passes").alias("pass"))
    out = frame.join(out, [zone, "pass"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("coverage", F.coalesce(F.try_divide("n", "core_cells"), F.lit(0.0)))


def zonal_mean(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over cells with a value, and their share of all cells, valued or not."""
    return cells.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        (F.count("value") / F.count(F.lit(1))).alias("valid_share"))


def block_mean(cells: DataFrame, factor: int, by: Sequence[str] = ("pass",),
               shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean of each factor x factor block, flagged ``full`` when every cell is there.

    Trailing blocks that stick out of the grid can never fill up and are dropped, by a filter the
    scan can use. Without a known ``shape`` the extent (one row) is read first.
    """
    by = list(by)
    if shape is None:
        end = measured(cells).agg(F.max("r"), F.max("c")).first()
        shape = (end[0] + 1, end[1] + 1) if end[0] is not None else (0, 0)
    inside = measured(cells).where((F.col("r") < shape[0] // factor * factor)
                                   & (F.col("c") < shape[1] // factor * factor))
    return (inside.groupBy(*by, F.floor(F.col("r") / factor).alias("br"),
                           F.floor(F.col("c") / factor).alias("bc"))
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
            .withColumn("full", F.col("n") == factor * factor))


def covalid(cells: DataFrame, passes: int) -> DataFrame:
    """(r, c) of cells measured on every pass."""
    return (measured(cells).groupBy("r", "c").agg(F.size(F.collect_set("pass")).alias("_n"))
            .where(F.col("_n") == passes).select("r", "c"))


def covalid_share(cells: DataFrame, passes: int) -> DataFrame:
    per = measured(cells).groupBy("r", "c").agg(F.size(F.collect_set("pass")).alias("_n"))
    return per.agg(F.count_if(F.col("_n") == passes).alias("covalid_cells"),
                   F.count(F.lit(1)).alias("all_cells"),
                   (F.count_if(F.col("_n") == passes) / F.count(F.lit(1))).alias("covalid_share"))


def full_blocks(cells: DataFrame, factor: int, passes: int,
                shape: tuple[int, int] | None = None) -> DataFrame:
    """Blocks that are full on every pass, so that all their cells are valid on every pass.

    A block full on each pass holds only cells valid on all passes and a block with such cells
    throughout is full on each, so cells need not be matched across passes one by one.
    """
    blocks = materialise(block_mean(cells, factor, shape=shape))
    whole = (blocks.where("full").groupBy("br", "bc").agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") == passes).select("br", "bc"))
    return blocks.join(whole, ["br", "bc"], "left_semi")


def stable_targets(blocks: DataFrame, select: Sequence, percentile: float = 99.9) -> DataFrame:
    """Blocks whose smallest value over the selection passes exceeds its own percentile."""
    low = materialise(blocks.where(F.col("pass").isin(*select)).groupBy("br", "bc")
                      .agg(F.min("value").alias("low")).where(F.col("low") > 0))
    cut = quantiles(low, [], "low", {"cut": percentile / 100.0})
    return null_safe_join(low, cut, []).where(F.col("low") > F.col("cut")).select("br", "bc", "low")


def pass_offsets(blocks: DataFrame, targets: DataFrame, master, skip: Sequence = (),
                 apply_min: float = 2.0) -> DataFrame:
    """Median of (master - pass) in dB on the stable targets; applied only when large enough."""
    on = blocks.join(targets.select("br", "bc"), ["br", "bc"], "left_semi")
    db = on.select("br", "bc", "pass", to_db(F.greatest("value", F.lit(FLOOR_POWER))).alias("db"))
    ref = db.where(F.col("pass") == master).select("br", "bc", F.col("db").alias("ref"))
    if skip:
        db = db.where(~F.col("pass").isin(*skip))
    gap = materialise(db.join(ref, ["br", "bc"]).select("pass", (F.col("ref") - F.col("db")).alias("gap")))
    return quantiles(gap, ["pass"], "gap", {"measured": 0.5}).withColumn(
        "applied", F.when(F.abs("measured") >= apply_min, F.col("measured")).otherwise(0.0))


def decile_profile(blocks: DataFrame, pass_a, pass_b, select: Sequence,
                   min_count: int = 20) -> DataFrame:
    """Median difference of two passes by decile of the darkest selection pass."""
    def db(cond: Column) -> Column:
        low = F.min(F.when(cond, F.col("value")))
        return to_db(F.when(low < FLOOR_POWER, F.lit(FLOOR_POWER)).otherwise(low))

    p = F.col("pass")
    wide = materialise(blocks.groupBy("br", "bc").agg(
        db(p.isin(*select)).alias("axis"), db(p == pass_a).alias("a"), db(p == pass_b).alias("b")))
    edges = materialise(quantiles(wide, [], "axis", {f"e{i}": i / 10.0 for i in range(11)}))
    binned = null_safe_join(wide, edges, []).withColumn("decile", sum(
        (F.when(F.col("axis") >= F.col(f"e{i}"), 1).otherwise(0) for i in range(1, 10)), F.lit(1)))
    binned = binned.withColumn("gap", F.col("a") - F.col("b"))
    low = F.array(*[F.col(f"e{i}") for i in range(11)])
    counts = binned.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.element_at(low, F.col("decile"))).alias("lo"),
        F.min(F.element_at(low, F.col("decile") + 1)).alias("hi"))
    med = quantiles(binned, ["decile"], "gap", {"median_gap": 0.5})
    return counts.where(F.col("n") >= min_count).join(med, "decile")


def target_levels(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Median power of the stable targets per pass, in dB."""
    on = blocks.join(targets.select("br", "bc"), ["br", "bc"], "left_semi").where("value > 0")
    return quantiles(on, ["pass"], "value", {"_m": 0.5}).select("pass", to_db(F.col("_m")).alias("level_db"))


def holdout_spread(blocks: DataFrame, targets: DataFrame, offsets: DataFrame, holdout: Sequence,
                   limit: float = 1.5) -> DataFrame:
    """Spread of offset-corrected levels over passes that took no part in the selection."""
    level = target_levels(blocks, targets).join(offsets.select("pass", "applied"), "pass")
    held = level.where(F.col("pass").isin(*holdout))
    fixed = F.col("level_db") + F.col("applied")
    return held.agg(
        (F.max(fixed) - F.min(fixed)).alias("spread_db"),
        (F.max("level_db") - F.min("level_db")).alias("raw_spread_db"),
    ).withColumn("passed", F.col("spread_db") <= limit)


def scene_drift(cells: DataFrame, labels: DataFrame, offsets: DataFrame, level_passes: Sequence,
                passes: int, first, percentile: float = 99.0) -> DataFrame:
    """Median level per pass of unlabelled ground, relative to the first pass.

    Ground must be valid on all passes, and its darkest level pass must not exceed the given
    percentile (which removes buildings).
    """
    shifted = (join_stats(measured(cells), offsets.select("pass", "applied"), ["pass"])
               .withColumn("value", F.col("value") * from_db(F.coalesce("applied", F.lit(0.0)))))
    p = F.col("pass")
    per_cell = shifted.groupBy("r", "c").agg(
        F.size(F.collect_set("pass")).alias("_n"),
        F.min(F.when(p.isin(*level_passes), F.col("value"))).alias("low"),
        *[F.max(F.when(p == x, F.col("value"))).alias(f"v{i}") for i, x in enumerate(level_passes)])
    ground = materialise(per_cell.where(F.col("_n") == passes)
                         .join(labels.select("r", "c"), ["r", "c"], "left_anti"))
    cut = quantiles(ground, [], "low", {"cut": percentile / 100.0})
    kept = null_safe_join(ground, cut, []).where(F.col("low") <= F.col("cut"))
    long = kept.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("pass"),
                 to_db(F.greatest(F.col(f"v{i}"), F.lit(FLOOR_POWER))).alias("db"))
        for i, x in enumerate(level_passes)])).alias("_s")).select("_s.pass", "_s.db")
    level = quantiles(long, ["pass"], "db", {"level_db": 0.5})
    base = level.where(p == first).agg(F.max("level_db").alias("_base"))
    return null_safe_join(level, base, []).withColumn(
        "drift_db", F.col("level_db") - F.col("_base")).drop("_base")


def fingerprint(cells: DataFrame, by: Sequence[str] = ("pass",)) -> DataFrame:
    v = F.col("value")
    return measured(cells).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"))


def footprint_iou(a: DataFrame, b: DataFrame, minimum: float = 0.95) -> DataFrame:
    """Overlap of two sets of valid cells."""
    left = measured(a).select("r", "c").distinct().withColumn("_a", F.lit(True))
    right = measured(b).select("r", "c").distinct().withColumn("_b", F.lit(True))
    both = left.join(right, ["r", "c"], "full")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(
        F.count_if(in_a & in_b).alias("n_both"), F.count(F.lit(1)).alias("n_union"),
        F.coalesce(F.try_divide(F.count_if(in_a & in_b), F.count(F.lit(1))), F.lit(0.0)).alias("iou"),
        F.try_divide(F.count_if(in_a & ~in_b),
                     F.greatest(F.count_if(in_a), F.lit(1))).alias("only_a"),
    ).withColumn("passed", F.col("iou") > minimum)


def radiometric_gate(cells: DataFrame, noise_db: DataFrame, block: int = 16,
                     bright_min: float = 15.0, margin_min: float = 3.0) -> DataFrame:
    """Per pass: median and maximum level, margin over noise, speckle of full blocks."""
    v = join_stats(measured(cells), noise_db.select("pass", "noise_db"), ["pass"], "inner")
    med = quantiles(v, ["pass"], "value", {"_m": 0.5})
    top = v.groupBy("pass").agg(
        to_db(F.max("value")).alias("max_db"), F.max("noise_db").alias("noise_db"),
        F.avg((to_db(F.col("value")) < F.col("noise_db")).cast("double")).alias("below_noise"))
    blocks = (v.groupBy("pass", F.floor(F.col("r") / block).alias("br"),
                        F.floor(F.col("c") / block).alias("bc"))
              .agg(F.count(F.lit(1)).alias("_n"),
                   (F.stddev_pop("value") / F.avg("value")).alias("cov"))
              .where(F.col("_n") == block * block))
    cov = quantiles(blocks, ["pass"], "cov", {"block_cov": 0.5})
    out = top.join(med, "pass").join(cov, "pass", "left")
    out = out.withColumn("median_db", to_db(F.col("_m"))).withColumns({
        "margin_db": F.col("median_db") - F.col("noise_db"),
        "enl": F.try_divide(F.lit(1.0), F.col("block_cov") * F.col("block_cov"))})
    return out.withColumn("passed", (F.col("max_db") >= bright_min)
                          & (F.col("margin_db") >= margin_min)).drop("_m")


def mosaic(cells: DataFrame, order: str = "src_order") -> DataFrame:
    """Overlapping sources merged: the first source with a value wins."""
    return measured(cells).groupBy("r", "c").agg(
        F.min_by("value", order).alias("value"), F.min(order).alias(order))


def grid_slice(cells: DataFrame, window: Mapping[str, float], x_min: float,
               y_max: float, cell: float = 1.0) -> DataFrame:
    """Cells of a map window; the bounds become constant row and column ranges."""
    r0 = int((y_max - window["y_max"]) / cell)
    c0 = int((window["x_min"] - x_min) / cell)
    rows = int((window["y_max"] - window["y_min"]) / cell)
    cols = int((window["x_max"] - window["x_min"]) / cell)
    return cells.where(F.col("r").between(r0, r0 + rows - 1)
                       & F.col("c").between(c0, c0 + cols - 1))


def composite(cells: DataFrame, passes: Sequence, offsets: Mapping | None = None,
              half_width: float = 5.0) -> DataFrame:
    """Three-channel stretch: dB about each pass's own median, scaled to 0..1.

    Cells not valid on every channel are 0 on all of them.
    """
    offs = offsets or {}
    p = F.col("pass")
    shift = None
    for k, v in offs.items():
        shift = F.when(p == k, float(v)) if shift is None else shift.when(p == k, float(v))
    shift = F.lit(0.0) if shift is None else shift.otherwise(0.0)
    db = (measured(cells).where(p.isin(*passes))
          .withColumn("db", to_db(F.col("value")) + shift))
    mid = quantiles(db, ["pass"], "db", {"mid": 0.5})
    scaled = join_stats(db, mid, ["pass"]).withColumn("s", F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), (F.col("db") - F.col("mid") + half_width) / (2 * half_width))))
    wide = scaled.groupBy("r", "c").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(p == x, F.col("s"))).alias(f"ch{i + 1}") for i, x in enumerate(passes)])
    whole = F.col("_n") == len(passes)
    return wide.select("r", "c", *[
        F.when(whole, F.col(f"ch{i + 1}")).otherwise(0.0).alias(f"ch{i + 1}")
        for i in range(len(passes))])
