"""Ordered operators that never gather a group into one task.

* ``running_sums``: running totals over a global or per-group order (two-level prefix sum).
* ``around``: the last value up to each row and the first one after it.
* ``average_rank``: rank with ties averaged.
* ``centred_ranks``: the same less its mean, for rows too many to meet a table of ranks.
* ``quantiles``: exact, linearly interpolated quantiles.
* ``share_cut``: ordered allocation by cumulative weight share.

A plain window over a cohort would sort the whole cohort in one task. Here rows are range
partitioned on (group, order), every range is summed on its own, and the range totals (one row per
range and group) shift the local running sums. A hot group spans many ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sources.stage import materialise


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where null matches null; key columns come from the left side.

    Without keys the right side must be a global aggregate, that is one row; only then is it
    broadcast by hint.
    """
    if not keys:
        return left.withColumn("_one", F.lit(1)).join(
            F.broadcast(right.withColumn("_one", F.lit(1))), "_one", how).drop("_one")
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                             for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of one row per group back to rows without moving the rows.

    The table is staged first: with its real size known, the optimiser broadcasts it when it is
    small and shuffles only when it is not. Left lazy, an aggregate has no usable size estimate
    and the rows would be shuffled by a key of a few values.
    """
    return null_safe_join(df, materialise(stats), keys, how)


def attach(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates to every row."""
    return join_stats(df, df.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()]), by)


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str],
                 sums: Mapping[str, Column]) -> DataFrame:
    """Inclusive running sums of ``sums`` within ``by``, ascending in ``order``.

    ``order`` must end in a column that makes rows distinct, so that equal leading values can be
    split over ranges.
    """
    by, order = list(by), list(order)
    names = list(sums)
    ranged = materialise(
        df.withColumns({f"_x_{n}": e for n, e in sums.items()})
          .repartitionByRange(*by, *order)
          .withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *by).agg(
        *[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *by, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    local = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    summed = ranged.withColumns({n: F.sum(f"_x_{n}").over(local) for n in names})
    out = join_stats(summed, offsets, ["_range", *by], "inner")
    return (out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in names})
               .drop("_range", *[f"_o_{n}" for n in names], *[f"_x_{n}" for n in names]))


def around(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, before: str, later: str) -> DataFrame:
    """Adds the last non-null ``value`` up to each row and the first one after it, in ``order``
    within ``by``; along the order ``value`` may not fall.

    Ranges are searched on their own; one row per range and group carries what lies beyond a
    range's edges, so a group of any length spans as many ranges as it needs.
    """
    by, order = list(by), list(order)
    ranged = materialise(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    upto = Window.unboundedPreceding
    ends = ranged.groupBy("_range", *by).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    group = Window.partitionBy(*by)
    ends = ends.select("_range", *by,
                       F.max("_hi").over(group.orderBy("_range").rowsBetween(upto, -1)).alias("_ob"),
                       F.min("_lo").over(group.orderBy(F.desc("_range")).rowsBetween(upto, -1)).alias("_ol"))
    local = Window.partitionBy("_range", *by)
    found = ranged.withColumns({
        before: F.max(value).over(local.orderBy(*order).rowsBetween(upto, 0)),
        later: F.min(value).over(local.orderBy(*[F.desc_nulls_last(c) for c in order]).rowsBetween(upto, -1))})
    out = join_stats(found, ends, ["_range", *by], "inner")
    return out.withColumns({before: F.coalesce(before, "_ob"), later: F.coalesce(later, "_ol")}).drop("_range", "_ob", "_ol")


def average_rank(df: DataFrame, column: str, by: Sequence[str] = (), rank: str = "avg_rank",
                 weight: Column | None = None) -> DataFrame:
    """Average-tie rank of ``column`` within ``by``; null values get a null rank.

    Ranks are found on distinct values only and joined back.
    """
    by = list(by)
    ranks = value_ranks(df.where(F.col(column).isNotNull()), column, by, weight)
    ranks = ranks.select(*by, column, F.col("mid_rank").alias(rank))
    return null_safe_join(df, ranks, [*by, column], "left")


def value_ranks(df: DataFrame, column: str, by: Sequence[str] = (), weight: Column | None = None,
                extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct value: ``n`` occurrences and the average rank they share."""
    by = list(by)
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    extra = dict(extra or {})
    values = df.groupBy(*by, column).agg(n.alias("n"), *[e.alias(k) for k, e in extra.items()])
    summed = running_sums(values, by, [column], {"upto": F.col("n")})
    return summed.withColumn("mid_rank", F.col("upto") - (F.col("n") - 1) / 2.0).drop("upto")


SKETCH_ACCURACY = 10_000
# Cells that a group's values are cut into at most, rows that a cell should hold, and parts that the
# rows of one hot value are dealt to.
CELLS, CELL_ROWS, PARTS = 1024, 1000, 64


def cell_edges(column: str) -> Column:
    """Aggregate: values that cut a group into cells of about equal size; a hot value is one of them."""
    cuts = F.percentile_approx(column, [i / CELLS for i in range(1, CELLS)], SKETCH_ACCURACY)
    every = F.ceil(F.lit(CELLS * CELL_ROWS) / F.greatest(F.count(column), F.lit(1)))
    return F.array_distinct(F.filter(cuts, lambda _, i: (i + 1) % every == 0))


def in_cells(df: DataFrame, by: Sequence[str], column: str, edges: DataFrame) -> DataFrame:
    """Adds ``_cell``: 2 i + 1 at the edge i of ``edges(*by, _edges)``, 2 i between it and the one before."""
    out = null_safe_join(df, edges, by).withColumn("_below", F.lit(0))
    step = CELLS // 2
    while step:
        past = F.get("_edges", F.col("_below") + (step - 1)) < F.col(column)
        out = out.withColumn("_below", F.col("_below") + F.when(past, step).otherwise(0))
        step //= 2
    at = F.coalesce(F.get("_edges", F.col("_below")) == F.col(column), F.lit(False))
    return out.withColumn("_cell", 2 * F.col("_below") + at.cast("int")).drop("_edges", "_below")


def cell_starts(df: DataFrame, by: Sequence[str], column: str, weight: str, edges: DataFrame) -> DataFrame:
    """(by, _cell, _held, _start): the weight in a cell, and below it less the group's mean rank."""
    held = in_cells(df, by, column, edges).groupBy(*by, "_cell").agg(F.sum(weight).alias("_held"))
    group = Window.partitionBy(*by)
    before = F.sum("_held").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    mean = (F.sum("_held").over(group) + 1) / 2.0
    return materialise(held.withColumn("_start", F.coalesce(before, F.lit(0)) - mean))


def centred_ranks(df: DataFrame, by: Sequence[str], column: str, weight: str, edges: DataFrame,
                  starts: DataFrame, deal: str, rank: str) -> DataFrame:
    """Adds the average-tie rank of ``column`` within ``by``, less the group's mean rank.

    Rows move once, to their cell, and are ranked there; ``starts`` tells what lies below a cell. A
    cell at an edge holds one value, whose rank follows from its count alone, so its rows are dealt
    to ``PARTS`` tasks by the whole number ``deal``, and a hot value is in no task as a whole.
    """
    by = list(by)
    at_edge = F.col("_cell") % 2 == 1
    part = F.col("_cell") * PARTS + F.when(at_edge, F.col(deal) % PARTS).otherwise(0)
    rows = in_cells(df, by, column, edges).withColumn("_part", part)
    order = Window.partitionBy("_part", *by).orderBy(column)
    rows = rows.withColumns({
        "_upto": F.sum(weight).over(order),
        "_ties": F.sum(weight).over(order.rangeBetween(Window.currentRow, Window.currentRow))})
    inside = F.when(at_edge, (F.col("_held") + 1) / 2.0).otherwise(F.col("_upto") - (F.col("_ties") - 1) / 2.0)
    return null_safe_join(rows, starts, [*by, "_cell"]).withColumn(rank, F.col("_start") + inside).drop(
        "_part", "_cell", "_upto", "_ties", "_held", "_start")


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` within ``by``.

    Two scans and no exchange of the rows themselves. A mergeable sketch brackets each wanted
    rank; the second scan counts rows per value inside the brackets and one total for every
    stretch between them, so only about ``8 / SKETCH_ACCURACY`` of a group leaves the map side. A
    stretch keeps its least and greatest value, which serves a rank right beside a bracket; a rank
    further off fails the job rather than returning an estimate.

    The result depends on the data only, not on the sketch.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    plist = sorted(set(probs.values()))
    margin = 4.0 / SKETCH_ACCURACY
    edges = [e for p in plist for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = materialise(rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", edges, SKETCH_ACCURACY).alias("_e")))
    lo = [F.lit(float("-inf")) if p - margin <= 0 else F.col("_e")[2 * i]
          for i, p in enumerate(plist)]
    hi = [F.lit(float("inf")) if p + margin >= 1 else F.col("_e")[2 * i + 1]
          for i, p in enumerate(plist)]
    inside = F.lit(False)
    for a, b in zip(lo, hi):
        inside = inside | F.col("_v").between(a, b)
    stretch = sum((F.when(F.col("_v") > b, 1).otherwise(0) for b in hi), F.lit(0))
    joined = null_safe_join(rows, sketch, by)
    counts = (joined
              .select(*by, "_v", F.when(inside, F.col("_v")).alias("_k"),
                      F.when(inside, F.lit(-1)).otherwise(stretch).alias("_s"), "_n")
              .groupBy(*by, "_k", "_s")
              .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v"), F.max("_v").alias("_top"),
                   F.first("_n").alias("_n")))
    ranked = running_sums(counts, by, ["_v"], {"_hi": F.col("_c")})
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_c"))

    def at(k: Column) -> Column:
        hit = (F.col("_lo") <= k) & (k < F.col("_hi"))
        sound = F.when((F.col("_s") == -1) | (k == F.col("_lo")), F.col("_v")).when(
            k == F.col("_hi") - 1, F.col("_top")).otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        return F.max(F.when(hit, sound))

    out = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        below = at(F.floor(pos))
        above = at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        out.append((below + (above - below) * frac).alias(name))
    return ranked.groupBy(*by).agg(*out)


def quantiles_of(df: DataFrame, by: Sequence[str], values: Sequence[str],
                 probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of several columns at once; result columns are ``<column>_<name>``."""
    by = list(by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(v).alias("_m"), F.col(v).cast("double").alias("_y")) for v in values
    ])).alias("_s")).select(*by, "_s._m", "_s._y")
    q = quantiles(long, [*by, "_m"], "_y", probs)
    return q.groupBy(*by).agg(*[
        F.max(F.when(F.col("_m") == v, F.col(n))).alias(f"{v}_{n}")
        for v in values for n in probs])


def cumulative_share(df: DataFrame, axis: str, key: str, weight: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """Share of the total weight up to and including each row in (axis, key) order."""
    by = list(by)
    total = attach(df, by, {"_w_total": F.sum(weight)})
    cum = running_sums(total, by, [axis, key], {"_w_cum": F.col(weight).cast("double")})
    return cum.withColumn("cum_share", F.col("_w_cum") / F.col("_w_total")).drop("_w_total", "_w_cum")


def prior_edges(prior: Sequence[float | Column]) -> list[Column]:
    """Inner cumulative edges of weights that are renormalised to one."""
    parts = [F.lit(float(p)) if isinstance(p, (int, float)) else p for p in prior]
    whole = sum(parts[1:], parts[0])
    edges: list[Column] = []
    for p in parts[:-1]:
        edges.append(p / whole if not edges else edges[-1] + p / whole)
    return edges


def share_label(share: Column, edges: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label numbered by how many edges lie strictly below the share."""
    bucket = sum((F.when(e < share, 1).otherwise(0) for e in edges), F.lit(1))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), bucket.cast("int"))


def share_cut(df: DataFrame, axis: str, key: str, weight: str, prior: Sequence[float],
              labels: Sequence[str], by: Sequence[str] = (), out: str = "bucket") -> DataFrame:
    """Allocate rows ordered by (axis, key) to ``labels`` so that weight shares match ``prior``."""
    return cumulative_share(df, axis, key, weight, by).withColumn(
        out, share_label(F.col("cum_share"), prior_edges(prior), labels))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str],
              name: str = "pos") -> DataFrame:
    """Distributed ``row_number`` within ``by`` (from 1)."""
    return running_sums(df, by, order, {name: F.lit(1).cast("long")})
