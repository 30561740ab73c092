"""Equi joins, interval joins and scenario expansion. No cross joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.ordered import around, join_stats, null_safe_join


def backtest_frame(obs: DataFrame, labels: DataFrame, key: str = "plot_id",
                   quality: str = "data_quality") -> DataFrame:
    """Inner join to the early labels, measured rows only (the filter is pushed below the join)."""
    return obs.join(labels, key, "inner").where(F.col(quality) == "measured")


def enrich(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    for other in others:
        base = base.join(other, key, "left")
    return base


def enrich_missing(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Left join that takes only the columns the base lacks."""
    new = [c for c in extra.columns if c not in base.columns]
    return base.join(extra.select(key, *new), key, "left") if new else base


def swap_label(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Replace ``label`` by another table's; a row without a new label fails the job."""
    new = labels.select(key, F.col(label).alias("_new"))
    checked = F.when(F.col("_new").isNull(), F.raise_error(F.concat(
        F.lit("no replacement label for "), F.col(key).cast("string"))).cast("string")
    ).otherwise(F.col("_new"))
    return df.drop(label).join(new, key, "left").withColumn(label, checked).drop("_new")


def compare(a: DataFrame, b: DataFrame, key: str, value: str,
            suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two aggregates side by side with their difference; a key on one side only counts as 0."""
    l, r = f"{value}{suffixes[0]}", f"{value}{suffixes[1]}"
    both = a.select(key, F.col(value).alias(l)).join(
        b.select(key, F.col(value).alias(r)), key, "full")
    filled = both.withColumns({l: F.coalesce(l, F.lit(0.0)), r: F.coalesce(r, F.lit(0.0))})
    return filled.withColumn("diff", F.col(r) - F.col(l))


def zonal_join(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells with the plot they belong to."""
    return cells.join(labels.select("r", "c", "plot_id"), ["r", "c"], "inner")


def nearest_date(targets: DataFrame, dates: DataFrame, target: str = "target", date: str = "d",
                 by: Sequence[str] = (), after: str | None = None) -> DataFrame:
    """Closest available date for each target date; equal distances take the earlier date.

    An as-of join: dates and distinct targets are ordered together, and each target sees the last
    date up to it and the first one after it. No series is gathered, whatever its number of days.
    ``after`` names a column of ``targets``; only strictly later dates then qualify. Null targets,
    null values of ``after`` and series without a date get null; null dates are ignored.
    """
    by = list(by)
    keys = [target, *([after] if after else [])]
    low = F.col(target)
    if after:
        low = F.when(F.col(target).isNotNull() & F.col(after).isNotNull(), F.greatest(target, after))
    # One probe looks back from the target, one ahead from what a later date must exceed.
    probe = F.explode(F.array(F.struct(F.col(target).alias("at"), F.lit(1).alias("kind")),
                              F.struct(low.alias("at"), F.lit(2).alias("kind"))))
    want = targets.select(*by, *keys).distinct().withColumn("_p", probe).select(
        *by, *keys, F.col("_p.at").alias("_at"), F.col("_p.kind").alias("_kind"))
    have = dates.select(*by, F.col(date).alias("_at")).where("_at is not null").distinct().select(
        *by, "_at", F.lit(0).alias("_kind"), F.col("_at").alias("_d"))
    both = want.where("_at is not null").unionByName(have, allowMissingColumns=True)
    seen = around(both, by, ["_at", "_kind", *keys], "_d", "_before", "_later").where("_kind > 0")
    pair = seen.groupBy(*by, *keys).agg(F.max(F.when(F.col("_kind") == 1, F.col("_before"))).alias("_before"),
                                        F.max(F.when(F.col("_kind") == 2, F.col("_later"))).alias("_later"))
    if after:
        pair = pair.withColumn("_before", F.when(F.col("_before") > F.col(after), F.col("_before")))
    gap_b = F.datediff(F.col(target), F.col("_before"))
    gap_l = F.datediff(F.col("_later"), F.col(target))
    best = F.when(F.col("_later").isNull() | (gap_b <= gap_l), F.col("_before")).otherwise(F.col("_later"))
    return join_stats(targets, pair.select(*by, *keys, best.alias("nearest")), [*by, *keys])


def lookback(events: DataFrame, daily: DataFrame, n: int, day: str = "d", value: str = "v",
             by: Sequence[str] = ()) -> DataFrame:
    """Rows of the n days strictly before each event day; a missing day has a null value.

    Each event day becomes n rows and meets the daily table by an equi join.
    """
    by = list(by)
    offs = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("back")
    expanded = events.select(*events.columns, offs).withColumn(
        "_day", F.date_sub(F.col(day), F.col("back")))
    days = daily.select(*by, F.col(day).alias("_day"), F.col(value).alias(value))
    return expanded.join(days, [*by, "_day"], "left").withColumnRenamed("_day", "past_day")


def with_scenarios(df: DataFrame, scenarios: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every row under every scenario. The scenario list is part of the plan, not a table."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])
    names = list(scenarios[0])
    return df.select("*", F.explode(rows).alias("_s")).select(
        *df.columns, *[F.col("_s")[n].alias(n) for n in names])


def with_draws(df: DataFrame, draws: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))


def unmatched_tokens(tokens: DataFrame, printed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tokens found in neither the printed corpus nor the allow-list."""
    return (tokens.select("token").distinct()
            .join(printed.select("token"), "token", "left_anti")
            .join(allowed.select("token"), "token", "left_anti"))


def duplicate_inputs(prints: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Inputs whose fingerprint equals that of an earlier input.

    One row per duplicate, naming the first input with that fingerprint: a group of n copies
    gives n - 1 rows, not n(n-1)/2.
    """
    first = prints.groupBy(*columns).agg(F.min(key).alias("first_input"),
                                         F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1").drop("copies")
    return (prints.join(first, list(columns), "inner")
            .where(F.col(key) > F.col("first_input"))
            .select("first_input", F.col(key).alias("duplicate"), *columns))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """k first rows per group, for groups that are bounded; ``order`` ends in a unique key.

    Spark keeps only k rows per group on the map side (window group limit) before the exchange.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(
        F.col("rank_in_group") <= k)


def resample_nearest(coarse: DataFrame, fine: DataFrame, factor: int, by: Sequence[str] = ()) -> DataFrame:
    """Value of the coarse cell that holds each fine cell centre, within the same ``by``."""
    keyed = fine.withColumns({"_cr": F.floor(F.col("r") / factor), "_cc": F.floor(F.col("c") / factor)})
    src = coarse.select(*by, F.col("r").alias("_cr"), F.col("c").alias("_cc"), "value")
    return keyed.join(src, [*by, "_cr", "_cc"], "left").drop("_cr", "_cc")


CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def dual_cells(coarse: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per square of four neighbouring coarse centres, with the values at its corners.

    The coarse grid is the small side, so copying each of its cells to four squares here lets
    every fine cell be joined once instead of four times.
    """
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in CORNERS]))
    k = coarse.select("*", at.alias("_k")).withColumns(
        {"_y0": F.col("r") - F.col("_k.dy"), "_x0": F.col("c") - F.col("_k.dx")})
    return k.groupBy(*by, "_y0", "_x0").agg(*[
        F.max(F.when((F.col("_k.dy") == a) & (F.col("_k.dx") == b), F.col(v))).alias(f"_{v}{a}{b}")
        for v in values for a, b in CORNERS])


def with_dual_position(fine: DataFrame, factor: int) -> DataFrame:
    y = (F.col("r") + 0.5) / factor - 0.5
    x = (F.col("c") + 0.5) / factor - 0.5
    return fine.withColumns({"_y0": F.floor(y), "_x0": F.floor(x), "_fy": y - F.floor(y), "_fx": x - F.floor(x)})


def bilinear(value: str) -> Column:
    """Weighted mean of the corners that have a value; null when none has."""
    def side(f: str, up: int) -> Column:
        return F.col(f) if up else 1.0 - F.col(f)

    num, den = F.lit(0.0), F.lit(0.0)
    for a, b in CORNERS:
        v, w = F.col(f"_{value}{a}{b}"), side("_fy", a) * side("_fx", b)
        num = num + F.coalesce(w * v, F.lit(0.0))
        den = den + F.when(v.isNotNull(), w).otherwise(0.0)
    return F.try_divide(num, den)


def resample_bilinear(coarse: DataFrame, fine: DataFrame, factor: int, by: Sequence[str] = ()) -> DataFrame:
    """Bilinear value at each fine cell centre from the four nearest coarse centres of its ``by``."""
    pos = with_dual_position(fine.select(*by, "r", "c"), factor)
    hit = pos.join(dual_cells(coarse.select(*by, "r", "c", "value"), ["value"], by), [*by, "_y0", "_x0"], "left")
    return hit.select(*by, "r", "c", bilinear("value").alias("value"))


def refine(coarse: DataFrame, factor: int, by: Sequence[str] = ()) -> DataFrame:
    """(by.., r, c, nearest, bilinear) of every fine cell under a coarse one; a coarse cell comes once.

    A coarse cell meets its eight neighbours and lays out its fine cells where it is, so only coarse
    cells move. The values are those of ``resample_nearest`` and ``resample_bilinear``.
    """
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in near]))
    k = coarse.select(*by, "r", "c", "value", at.alias("_k"))

    def from_(a: int, b: int) -> Column:
        return (F.col("_k.dy") == a) & (F.col("_k.dx") == b)

    met = k.groupBy(*by, (F.col("r") - F.col("_k.dy")).alias("_r"), (F.col("c") - F.col("_k.dx")).alias("_c")).agg(
        F.max(from_(0, 0)).alias("_own"), *[F.max(F.when(from_(a, b), F.col("value"))).alias(f"_n{a + 1}{b + 1}") for a, b in near])
    steps = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    fine = met.where("_own").select("*", steps.alias("_i")).select("*", steps.alias("_j")).withColumns(
        {"r": F.col("_r") * factor + F.col("_i"), "c": F.col("_c") * factor + F.col("_j")})
    pos = with_dual_position(fine, factor)
    up, left = F.col("_y0") < F.col("_r"), F.col("_x0") < F.col("_c")

    def corner(a: int, b: int) -> Column:
        def n(i: int, j: int) -> Column:
            return F.col(f"_n{i + a}{j + b}")
        return F.when(up & left, n(0, 0)).when(up, n(0, 1)).when(left, n(1, 0)).otherwise(n(1, 1))

    hit = pos.withColumns({f"_value{a}{b}": corner(a, b) for a, b in CORNERS})
    return hit.select(*by, "r", "c", F.col("_n11").alias("nearest"), bilinear("value").alias("bilinear"))


def resample_mask(mask: DataFrame, fine: DataFrame, factor: int, by: Sequence[str] = ()) -> DataFrame:
    """Boolean mask carried to the fine grid by bilinear weights and cut at one half."""
    as_value = mask.select(*by, "r", "c", F.col("valid").cast("double").alias("value"))
    return resample_bilinear(as_value, fine, factor, by).select(
        *by, "r", "c", (F.coalesce("value", F.lit(0.0)) > 0.5).alias("valid"))


def carry_index(index: DataFrame, labels: DataFrame, factor: int,
                by: Sequence[str] = ("window",)) -> DataFrame:
    """Index and validity of a coarse grid at the labelled fine cells: (plot_id, by.., value).

    A fine cell keeps its value only where the carried mask exceeds one half.
    """
    src = index.select(*by, "r", "c", "value", F.col("value").isNotNull().cast("double").alias("ok"))
    pos = with_dual_position(labels.select("plot_id", "r", "c"), factor)
    hit = pos.join(dual_cells(src, ["value", "ok"], by), ["_y0", "_x0"])
    return hit.select("plot_id", *by, F.when(bilinear("ok") > 0.5, bilinear("value")).alias("value"))
