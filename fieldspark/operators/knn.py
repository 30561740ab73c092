"""Exact k nearest neighbours by an adaptive grid, without cross joins or cell-wide pair lists.

Cells halve in size from level to level, level 0 being one cell over everything. A query point
works at the finest level whose own cell still holds enough donors, or at level 0. All of them lie
within one cell diagonal, which is shorter than two cell sides, so the 5 x 5 block around the own
cell holds every neighbour: one join settles every query, in dense and sparse areas alike.

The levels in use follow the data: from the one at which the bulk of the donors starts to part, down
to the one at which no cell is crowded. A far outlier thus costs a level, not the resolution.

Points that share a location tie in distance and are ordered by key, so only the first few keys
of a location can ever be neighbours; a location repeated a billion times costs a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

DEEPEST = 44        # cells of 2^-44 of the extent: as fine as doubles can tell
SCOUTS = 100_000    # cells looked at to choose the levels; the result does not depend on them
CROWD = 16          # times the donors wanted, from which a cell is crowded
SPOTS = 8192        # locations whose candidate pairs one task holds, on average


def _cell(value: str, low: str, level: Column) -> Column:
    """Cell index along one axis; the side of a cell at ``level`` is extent / 2^level."""
    cells = F.pow(F.lit(2.0), level)
    return F.least(F.floor((F.col(value) - F.col(low)) / F.col("_extent") * cells),
                   (cells - 1).cast("long"))


def donor_gate(donors: DataFrame, k: int) -> DataFrame:
    """Fewer donors than neighbours wanted fails the job. Reads at most k rows."""
    if len(donors.select(F.lit(1)).limit(k).collect()) < k:
        raise ValueError(f"fewer than {k} donors")
    return donors


def knn_join(queries: DataFrame, donors: DataFrame, k: int, query_key: str = "query_id",
             donor_key: str = "donor_id", exclude_self: bool = False) -> DataFrame:
    """(query_key, donor_key, distance, nn) for the k nearest donors; ties go to the smaller key.

    Both inputs carry ``x`` and ``y``. With ``exclude_self`` a donor with the query's own key is
    not its neighbour. Where there are fewer donors than ``k``, all of them are neighbours.
    """
    want = k + 1 if exclude_self else k
    d = donors.select(F.col(donor_key).alias("_d"), "x", "y")
    by_location = Window.partitionBy("x", "y").orderBy("_d")
    d = materialise(d.withColumn("_i", F.row_number().over(by_location))
                     .where(F.col("_i") <= want).drop("_i"))
    q = queries.select(F.col(query_key).alias("_q"), "x", "y")
    spots = q.select("x", "y").distinct()
    box = d.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"),
                F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    qbox = spots.agg(F.min("x").alias("_qx0"), F.min("y").alias("_qy0"),
                     F.max("x").alias("_qx1"), F.max("y").alias("_qy1"))
    frame = null_safe_join(box, qbox, []).select(
        F.least("_x0", "_qx0").alias("_x0"), F.least("_y0", "_qy0").alias("_y0"),
        F.greatest("_x1", "_qx1").alias("_x1"), F.greatest("_y1", "_qy1").alias("_y1"))
    frame = materialise(frame.select("_x0", "_y0", F.greatest(
        F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-9)).alias("_extent")))

    fine = finest(d, frame)
    levels = chosen_levels(fine, want)
    ladder = F.explode(F.array(*[F.lit(x) for x in levels])).alias("_l")

    def laddered(df: DataFrame) -> DataFrame:
        return null_safe_join(df, frame, []).select("*", ladder).withColumns(
            {"_cx": _cell("x", "_x0", F.col("_l")), "_cy": _cell("y", "_y0", F.col("_l"))})

    # Donors per cell, level by level, from the finest cells up. Level 0 serves whoever is left.
    counts = (coarser(fine, levels).groupBy("_l", "_cx", "_cy").agg(F.sum("_n").alias("_n"))
              .where((F.col("_n") >= want) | (F.col("_l") == 0)))
    level = (laddered(spots).join(counts, ["_l", "_cx", "_cy"], "left_semi")
             .groupBy("x", "y").agg(F.max("_l").alias("_l")))
    located = materialise(null_safe_join(level, frame, []).withColumns(
        {"_cx": _cell("x", "_x0", F.col("_l")), "_cy": _cell("y", "_y0", F.col("_l"))}))

    side = F.col("_extent") / F.pow(F.lit(2.0), F.col("_l"))
    ring = F.sequence(F.lit(-2), F.lit(2))
    block = (located
             .select("x", "y", "_l", "_cx", "_cy", "_x0", "_y0", "_extent",
                     F.explode(ring).alias("_dx"))
             .select("*", F.explode(ring).alias("_dy"))
             .withColumns({"_bx": F.col("_cx") + F.col("_dx"), "_by": F.col("_cy") + F.col("_dy")}))

    # Drop block cells that lie wholly beyond the farthest corner of the own cell.
    def reach(v: str, low: str, own: str) -> Column:
        a = F.col(low) + F.col(own) * side
        return F.greatest(F.col(v) - a, a + side - F.col(v))

    def gap(v: str, low: str, cell: str) -> Column:
        a = F.col(low) + F.col(cell) * side
        return F.greatest(a - F.col(v), F.col(v) - (a + side), F.lit(0.0))

    radius2 = F.pow(reach("x", "_x0", "_cx"), 2) + F.pow(reach("y", "_y0", "_cy"), 2)
    gap2 = F.pow(gap("x", "_x0", "_bx"), 2) + F.pow(gap("y", "_y0", "_by"), 2)
    block = block.where(gap2 <= radius2 * (1 + 1e-9)).select("x", "y", "_l", "_bx", "_by")

    used = block.select("_l").distinct()
    donors_at = laddered(d).join(used, "_l", "left_semi").select("_l", F.col("_cx").alias("_bx"), F.col("_cy").alias("_by"), "_d",
                                 F.col("x").alias("_px"), F.col("y").alias("_py"))
    # Pairs are many more than what is shuffled for them, so tasks are dealt by locations, not by bytes.
    if (tasks := -(-located.count() // SPOTS)) > 1:
        block, donors_at = (side_.repartition(tasks, "_l", "_bx", "_by") for side_ in (block, donors_at))
    pairs = block.join(donors_at, ["_l", "_bx", "_by"]).select(
        "x", "y", "_d",
        F.sqrt(F.pow(F.col("x") - F.col("_px"), 2)
               + F.pow(F.col("y") - F.col("_py"), 2)).alias("distance"))
    nearest = Window.partitionBy("x", "y").orderBy("distance", "_d")
    near = pairs.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= want)
    if not exclude_self:
        return (q.join(near, ["x", "y"])
                .select(F.col("_q").alias(query_key), F.col("_d").alias(donor_key), "distance",
                        F.col("_r").alias("nn")))
    # A query's own key is among the first k + 1 of its location or it is not: drop it, renumber.
    lists = near.groupBy("x", "y").agg(F.array_sort(F.collect_list(
        F.struct("_r", "_d", "distance"))).alias("_near"))
    mine = q.join(lists, ["x", "y"]).withColumn(
        "_near", F.slice(F.filter("_near", lambda s: s["_d"] != F.col("_q")), 1, k))
    return mine.select(F.col("_q").alias(query_key), F.posexplode("_near").alias("_p", "_s")).select(
        query_key, F.col("_s._d").alias(donor_key), F.col("_s.distance").alias("distance"),
        (F.col("_p") + 1).alias("nn"))


def finest(points: DataFrame, frame: DataFrame) -> DataFrame:
    """Points per finest cell; coarser cells are these indices halved."""
    at = null_safe_join(points, frame, []).withColumn("_l", F.lit(DEEPEST))
    return (at.select(_cell("x", "_x0", F.col("_l")).alias("_fx"),
                      _cell("y", "_y0", F.col("_l")).alias("_fy"))
            .groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("_n")))


def coarser(fine: DataFrame, levels: list[int]) -> DataFrame:
    """(_l, _cx, _cy, _n): finest cells as parts of their cells at each of ``levels``."""
    at = fine.select("_n", F.explode(F.array(*[F.lit(x) for x in levels])).alias("_l"), "_fx", "_fy")
    side = F.pow(F.lit(2.0), DEEPEST - F.col("_l"))
    return at.select("_n", "_l", F.floor(F.col("_fx") / side).alias("_cx"), F.floor(F.col("_fy") / side).alias("_cy"))


def chosen_levels(fine: DataFrame, want: int) -> list[int]:
    """Level 0, and the levels between the one where no cell holds half of the donors and the one
    where none is crowded, judged by a bounded number of cells."""
    cells = fine.count()
    scouts = fine if cells <= SCOUTS else fine.where(
        F.pmod(F.xxhash64("_fx", "_fy"), F.lit(1 << 20)) < (1 << 20) * SCOUTS / cells)
    most = (coarser(scouts, list(range(DEEPEST + 1))).groupBy("_l", "_cx", "_cy").agg(F.sum("_n").alias("_n"))
            .groupBy("_l").agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).collect())
    share = min(1.0, SCOUTS / max(cells, 1))
    whole = [r["_l"] for r in most if 2 * r["most"] >= r["all"]]
    crowded = [r["_l"] for r in most if r["most"] >= CROWD * want * share]
    top = max(whole, default=0)
    last = max(crowded, default=top)
    return sorted({0, *range(top, min(last + 1, DEEPEST) + 1)})
