"""Polygons as vertex lists: ``plots(plot_id, parts ARRAY<ARRAY<STRUCT<x, y>>>)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sources.stage import materialise

ERODE_MAX = 4.0
ERODE_FRACTION = 0.25


def edges_of(plots: DataFrame, key: str = "plot_id") -> DataFrame:
    """(plot_id, part, x1, y1, x2, y2); rings are closed if the last vertex is not the first."""
    ring = F.col("ring")
    parts = plots.select(key, F.posexplode("parts").alias("part", "ring"))
    n = F.size("ring")
    e = parts.select(key, "part", "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    nxt = F.pmod(F.col("i") + 1, n)
    return e.select(key, "part", ring[F.col("i")]["x"].alias("x1"), ring[F.col("i")]["y"].alias("y1"),
                    ring[nxt]["x"].alias("x2"), ring[nxt]["y"].alias("y2"))


def polygon_measures(plots: DataFrame, key: str = "plot_id") -> DataFrame:
    """Area, perimeter, centroid and the erosion distance of each plot (shoelace sums).

    A plot without area takes the mean vertex as centroid and is not eroded.
    """
    e = edges_of(plots, key)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    s = e.groupBy(key, "part").agg(
        (F.sum(cross) / 2).alias("a"), F.sum(length).alias("p"),
        (F.sum((F.col("x1") + F.col("x2")) * cross) / 6).alias("mx"),
        (F.sum((F.col("y1") + F.col("y2")) * cross) / 6).alias("my"),
        F.sum("x1").alias("sx"), F.sum("y1").alias("sy"), F.count(F.lit(1)).alias("n"))
    sign = F.signum("a")
    t = s.groupBy(key).agg(
        F.sum(F.abs("a")).alias("area"), F.sum("p").alias("perimeter"),
        F.sum(F.col("mx") * sign).alias("mx"), F.sum(F.col("my") * sign).alias("my"),
        (F.sum("sx") / F.sum("n")).alias("vx"), (F.sum("sy") / F.sum("n")).alias("vy"))
    has = F.col("area") > 0
    erode = F.least(F.lit(ERODE_MAX), ERODE_FRACTION * F.coalesce(
        F.try_divide(F.col("area"), F.col("perimeter")), F.lit(0.0)))
    return t.select(key, "area", "perimeter",
                    F.when(has, F.try_divide(F.col("mx"), F.col("area"))).otherwise(F.col("vx")).alias("cx"),
                    F.when(has, F.try_divide(F.col("my"), F.col("area"))).otherwise(F.col("vy")).alias("cy"),
                    erode.alias("erode"))


def orientation(plots: DataFrame, key: str = "plot_id") -> DataFrame:
    """Azimuth of the long axis in 0..180 and elongation, from the vertices of the first ring.

    The 2 x 2 covariance has a closed-form principal axis; under three vertices gives null.
    """
    v = plots.select(key, F.explode(F.col("parts")[0]).alias("p")).select(key, "p.x", "p.y")
    m = v.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("a"),
                           F.var_samp("y").alias("c"), F.covar_samp("x", "y").alias("b"))
    half = (F.col("a") - F.col("c")) / 2.0
    root = F.sqrt(half * half + F.col("b") * F.col("b"))
    mid = (F.col("a") + F.col("c")) / 2.0
    big, small = mid + root, mid - root
    angle = 0.5 * F.atan2(2.0 * F.col("b"), F.col("a") - F.col("c"))
    azimuth = F.pmod(90.0 - F.degrees(angle), F.lit(180.0))
    ok = F.col("n") >= 3
    return m.select(key, F.when(ok, azimuth).alias("azimuth"),
                    F.when(ok & (small > 0), F.sqrt(F.try_divide(big, small))).alias("elongation"))


def scan_lines(plots: DataFrame, cell: float, key: str) -> DataFrame:
    """(plot_id, r, cs): for each row of cells that a plot reaches, the first column at or right of
    every crossing, in order.

    Row r has its centre at (r + 0.5) * cell; an edge covers low <= centre < high.
    """
    e = edges_of(plots, key).where(F.col("y1") != F.col("y2"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.ceil(low / cell - 0.5)
    last = F.ceil(high / cell - 0.5) - 1
    rows = e.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("r"))
    y = (F.col("r") + 0.5) * cell
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return rows.select(key, "r", F.ceil(x / cell - 0.5).alias("c")).groupBy(key, "r").agg(
        F.sort_array(F.collect_list("c")).alias("cs"))


def cells_of_lines(lines: DataFrame, key: str) -> DataFrame:
    spans = F.transform(F.sequence(F.lit(0), (F.size("cs") / 2 - 1).cast("int")),
                        lambda i: F.struct(F.col("cs")[i * 2].alias("a"), (F.col("cs")[i * 2 + 1] - 1).alias("b")))
    return lines.select(key, "r", F.explode(spans).alias("s")).where("s.a <= s.b").select(
        key, "r", F.explode(F.sequence("s.a", "s.b")).alias("c"))


def cells_in_polygons(plots: DataFrame, cell: float = 1.0, key: str = "plot_id") -> DataFrame:
    """(plot_id, r, c) of cells whose centre is inside, by the even-odd rule along scan lines.

    Every edge meets the rows it crosses; the sorted crossings of a row pair up into inside
    spans. Work grows with edges crossed plus cells found, and a huge plot is split by row.
    """
    return cells_of_lines(scan_lines(plots, cell, key), key)


def edge_distance(x: Column, y: Column) -> Column:
    """Distance from a point to the edge (x1, y1)-(x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy),
                   F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(x - (F.col("x1") + t * dx), 2) + F.pow(y - (F.col("y1") + t * dy), 2))


# Left and right of all columns.
FAR = 1 << 60


def ruled_out(edges: DataFrame, cell: float, key: str) -> DataFrame:
    """(plot_id, r, lo, hi): the columns of a row whose centres lie within ``erode`` of an edge.

    Around an edge lie a disc at each end and a strip between them; together they are convex, so
    a row cuts one interval out of them. Its ends come from the closed forms of the discs and the
    strip's long sides, and the columns beside them are tested by their distance, so rounding
    cannot move an end.
    """
    e, y = F.col("erode"), (F.col("r") + 0.5) * cell
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    ends = []
    for n in ("1", "2"):
        up = y - F.col(f"y{n}")
        half = F.when(F.abs(up) < e, F.sqrt(e * e - up * up))
        ends += [F.col(f"x{n}") - half, F.col(f"x{n}") + half]
    for side in (-1.0, 1.0):
        ox, oy = F.try_divide(side * e * dy, length), F.try_divide(-side * e * dx, length)
        t = F.try_divide(y - F.col("y1") - oy, dy)
        ends.append(F.when(t.between(0.0, 1.0), F.col("x1") + ox + t * dx))
    first = F.floor((F.least("y1", "y2") - e) / cell - 0.5)
    last = F.ceil((F.greatest("y1", "y2") + e) / cell - 0.5)
    rows = edges.select(key, "x1", "y1", "x2", "y2", "erode", F.explode(F.sequence(first, last)).alias("r"))
    cut = rows.withColumns({"_a": F.least(*ends), "_b": F.greatest(*ends)}).where("_a is not null")
    cut = cut.withColumns({"_a": F.ceil(F.col("_a") / cell - 0.5), "_b": F.floor(F.col("_b") / cell - 0.5)})

    def near(c: Column) -> Column:
        return edge_distance((c + 0.5) * cell, y) < e

    lo, hi = F.col("_a"), F.col("_b")
    return cut.select(key, "r", F.when(near(lo - 1), lo - 1).when(near(lo), lo).otherwise(lo + 1).alias("lo"),
                      F.when(near(hi + 1), hi + 1).when(near(hi), hi).otherwise(hi - 1).alias("hi")).where("lo <= hi")


def core_cells(plots: DataFrame, cell: float = 1.0, key: str = "plot_id") -> DataFrame:
    """Cells at least the erosion distance inside; a plot without such cells keeps them all.

    What lies outside a plot and what its edges rule out are intervals of a row. Sorted once, what
    no interval covers is the core, so no row stands for a cell and an edge.
    """
    lines = materialise(scan_lines(plots, cell, key))
    m = (F.size("cs") / 2).cast("int")
    beyond = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(
        F.when(i == 0, F.lit(-FAR)).otherwise(F.col("cs")[i * 2 - 1]).alias("lo"),
        F.when(i == m, F.lit(FAR)).otherwise(F.col("cs")[i * 2] - 1).alias("hi")))
    outside = lines.select(key, "r", F.explode(beyond).alias("s")).where("s.lo <= s.hi").select(key, "r", "s.lo", "s.hi")
    erode = polygon_measures(plots, key).select(key, "erode")
    edges = edges_of(plots, key).join(erode, key).where(F.col("erode") > 0)
    every = outside.unionByName(ruled_out(edges, cell, key))
    row = Window.partitionBy(key, "r").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    # A row that edges reach but no plot's line crosses has no far left, so nothing of it is free.
    met = Window.partitionBy(key, "r")
    free = every.withColumns({"_to": F.max("hi").over(row), "_left": F.min("lo").over(met)}).where(
        (F.col("_left") == -FAR) & (F.col("_to") + 1 < F.col("lo")))
    core = materialise(free.select(key, "r", (F.col("_to") + 1).alias("a"), (F.col("lo") - 1).alias("b")))
    whole = lines.join(core.select(key).distinct(), key, "left_anti")
    return core.select(key, "r", F.explode(F.sequence("a", "b")).alias("c")).unionByName(cells_of_lines(whole, key))


def largest_overlap(plot_cells: DataFrame, region_cells: DataFrame, centroids: DataFrame,
                    cell: float = 1.0, key: str = "plot_id") -> DataFrame:
    """Region sharing most cells with each plot (ties to the largest name); a plot that shares
    none goes by its centroid cell, else stays unassigned.

    Both tables of cells are shuffled: exploded cells are many more rows than their size estimate
    says, so a broadcast would gather a whole table in the driver.
    """
    region_cells = region_cells.hint("merge")
    share = plot_cells.join(region_cells, ["r", "c"]).groupBy(key, "region").agg(
        F.count(F.lit(1)).alias("n"))
    best = share.groupBy(key).agg(F.max(F.struct("n", "region")).alias("_b"))
    at = centroids.select(key, F.floor(F.col("cy") / cell).alias("r"), F.floor(F.col("cx") / cell).alias("c"))
    rest = at.join(best, key, "left_anti")
    by_centroid = rest.join(region_cells, ["r", "c"]).groupBy(key).agg(F.min("region").alias("_c"))
    j = centroids.select(key).join(best, key, "left").join(by_centroid, key, "left")
    return j.select(key, F.coalesce(F.col("_b.region"), F.col("_c")).alias("region"),
                    F.coalesce(F.col("_b.n"), F.lit(0)).alias("shared_cells"),
                    F.when(F.col("_b").isNotNull(), "area").when(F.col("_c").isNotNull(), "centroid")
                    .otherwise("outside").alias("how"))


def containment(assigned: DataFrame, declared: DataFrame, key: str = "plot_id") -> DataFrame:
    """Counts and weights of plots that agree with their declared region, disagree, or lie outside."""
    j = assigned.join(declared.select(key, F.col("region").alias("_said"), "weight"), key)
    out = F.col("region").isNull()
    same = F.col("region") == F.col("_said")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(same, F.lit(False))).alias("n_agree"),
        F.count_if(~out & ~F.coalesce(same, F.lit(False))).alias("n_disagree"),
        F.count_if(F.col("how") == "centroid").alias("n_by_centroid"),
        F.count_if(out).alias("n_outside"), F.sum("weight").alias("weight"),
        F.sum(F.when(out, F.col("weight")).otherwise(0.0)).alias("weight_outside"))
