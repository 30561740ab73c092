"""The roles of the operators' inputs, bound to the given tables: each as Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.plans.registry import Tables

# Means of amounts with two decimals often fall exactly on a rounding edge, where the order of
# summation decides. Dividing by a constant with a large prime factor keeps the magnitudes and
# removes those ties from both sides.
UNTIE = 0.997

# -- cells with zones, and grid cells ---------------------------------------------------------
CELLS = """SELECT l_suppkey AS plot_id, year(l_shipdate)::BIGINT AS pass, l_extendedprice / 0.997::DOUBLE AS value
FROM lineitem"""
GRID = """SELECT l_suppkey AS r, l_partkey % 8 AS c, year(l_shipdate)::BIGINT AS pass,
avg(l_extendedprice) / 0.997::DOUBLE AS value FROM lineitem GROUP BY 1, 2, 3"""


def pass_of(ts: str) -> Column:
    return F.year(ts).cast("long")


def cells(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("plot_id"), pass_of("l_shipdate").alias("pass"),
                             (F.col("l_extendedprice") / UNTIE).alias("value"))


def grid(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("r"), (F.col("l_partkey") % 8).alias("c"),
        pass_of("l_shipdate").alias("pass")).agg((F.avg("l_extendedprice") / UNTIE).alias("value"))


PASSES = (1995, 1996, 1997, 1998, 1999, 2000, 2001)


def grid_labels(t: Tables) -> DataFrame:
    """Cells of the first six columns belong to the plot of their row."""
    return t.lineitem.select(F.col("l_suppkey").alias("r"), (F.col("l_partkey") % 8).alias("c")).where(
        "c < 6").distinct().withColumn("plot_id", F.col("r"))


GRID_LABELS = "SELECT DISTINCT l_suppkey AS r, l_partkey % 8 AS c, l_suppkey AS plot_id FROM lineitem WHERE l_partkey % 8 < 6"

# -- observations over passes -----------------------------------------------------------------
SLOT = "((day(ts) - 1) // 5)::BIGINT"
OBS = f"""SELECT user_id AS plot_id, {SLOT} AS pass, ({SLOT} * 5 + 3)::DOUBLE AS doy, avg(value) / 0.997::DOUBLE AS v
FROM events GROUP BY 1, 2, 3"""
GAPS = f"""SELECT user_id AS plot_id, {SLOT} AS pass, avg(value) / 0.997::DOUBLE AS v, count(*) AS n
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""
DOYS = {i: 5.0 * i + 3.0 for i in range(6)}


def slot() -> Column:
    return F.floor((F.dayofmonth("ts") - 1) / 5)


def obs(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("plot_id"), slot().alias("pass")).agg(
        (F.avg("value") / UNTIE).alias("v")).select(
        "plot_id", "pass", (F.col("pass") * 5 + 3).cast("double").alias("doy"), "v")


def gaps(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy(
        F.col("user_id").alias("plot_id"), slot().alias("pass")).agg(
        (F.avg("value") / UNTIE).alias("v"), F.count(F.lit(1)).alias("n"))


# Every plot and pass, null where the plot has no purchase in the slot.
FULL = f"""SELECT p.plot_id, s.pass, (s.pass * 5 + 3)::DOUBLE AS doy, g.v
FROM (SELECT DISTINCT plot_id FROM ({GAPS}) a) p, (SELECT unnest(range(6)) AS pass) s
LEFT JOIN ({GAPS}) g ON g.plot_id = p.plot_id AND g.pass = s.pass"""


def full(t: Tables) -> DataFrame:
    from fieldspark.operators.series import with_all_passes
    return with_all_passes(gaps(t), {i: d for i, d in DOYS.items()}).withColumn(
        "pass", F.col("pass").cast("long"))


# Departures: value against the mean of the first two slots, scaled to a few units.
DEP = f"""SELECT plot_id, pass, doy, v, (v - avg(v) FILTER (pass < 2) OVER (PARTITION BY plot_id)) / 20.0
AS departure FROM ({OBS}) o"""


def dep(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    base = F.avg(F.when(F.col("pass") < 2, F.col("v"))).over(Window.partitionBy("plot_id"))
    return obs(t).withColumn("departure", (F.col("v") - base) / 20.0)


# -- plots ------------------------------------------------------------------------------------
PLOTS = """SELECT p_partkey AS plot_id, p_type AS cls, p_brand AS brand, p_size::DOUBLE AS weight,
p_retailprice / 1000.0 AS value, p_size / 50.0 AS fraction,
CASE WHEN p_size >= 25 THEN 'high' ELSE 'low' END AS confidence FROM part"""


def plots(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("plot_id"), F.col("p_type").alias("cls"), F.col("p_brand").alias("brand"),
        F.col("p_size").cast("double").alias("weight"), (F.col("p_retailprice") / 1000.0).alias("value"),
        (F.col("p_size") / 50.0).alias("fraction"),
        F.when(F.col("p_size") >= 25, "high").otherwise("low").alias("confidence"))


# Fixed values of the binding: a reference, a calendar end and a plausible band per class.
REFERENCE = {"ECONOMY": 1.25, "LARGE": 1.5, "MEDIUM": 1.75, "PROMO": 2.0, "SMALL": 2.25, "STANDARD": 2.5}
CALENDAR = {"ECONOMY": 20, "LARGE": 27, "MEDIUM": 28, "PROMO": 31, "SMALL": 36, "STANDARD": 40}
BANDS = {"ECONOMY": (0.5, 2.5), "LARGE": (0.5, 2.5), "MEDIUM": (0.5, 3.0), "PROMO": (0.5, 3.0),
         "SMALL": (0.5, 3.5), "STANDARD": (0.5, 1.0)}
CLASSES = tuple(REFERENCE)


def sql_map(table: dict, key: str = "cls") -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in table.items()) + " END)"


# -- points, vectors --------------------------------------------------------------------------
POINTS = """SELECT vec_id AS plot_id, 5000 * embedding[1]::DOUBLE AS x, 5000 * embedding[2]::DOUBLE AS y,
embedding[3]::DOUBLE AS v, label::BIGINT AS label, embedding[4]::DOUBLE AS b,
1.0::DOUBLE + label AS weight, embedding[5]::DOUBLE AS fraction FROM embeddings"""


def points(t: Tables) -> DataFrame:
    def e(i: int) -> Column:
        return F.col("embedding")[i].cast("double")

    return t.embeddings.select(
        F.col("vec_id").alias("plot_id"), (5000 * e(0)).alias("x"), (5000 * e(1)).alias("y"),
        e(2).alias("v"), F.col("label").cast("long").alias("label"), e(3).alias("b"),
        (1.0 + F.col("label")).alias("weight"), e(4).alias("fraction"))


ELEMENTS = 64
DIMS = [f"e{i}" for i in range(ELEMENTS)]
VECTORS = "SELECT vec_id AS plot_id, label::BIGINT AS cluster, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(ELEMENTS)) + " FROM embeddings"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("plot_id"), F.col("label").cast("long").alias("cluster"),
                               *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(ELEMENTS)])


# -- two instruments on the same orders -------------------------------------------------------
PAIRS = """SELECT o_orderkey AS plot_id, o_orderpriority AS cls, o_totalprice / 0.997::DOUBLE AS x, o_orderstatus AS status,
l.y, l.q, l.first_y, o_orderdate AS ts FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) / 0.997::DOUBLE AS y,
sum(l_quantity) AS q, max(l_extendedprice) AS first_y FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""


def pairs(t: Tables) -> DataFrame:
    li = t.lineitem.groupBy("l_orderkey").agg(
        (F.sum("l_extendedprice") / UNTIE).alias("y"), F.sum("l_quantity").alias("q"),
        F.max("l_extendedprice").alias("first_y"))
    return t.orders.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("plot_id"), F.col("o_orderpriority").alias("cls"),
        (F.col("o_totalprice") / UNTIE).alias("x"), F.col("o_orderstatus").alias("status"), "y", "q", "first_y",
        F.col("o_orderdate").alias("ts"))


# -- daily series -----------------------------------------------------------------------------
DAILY = "SELECT event_type AS source, ts::DATE AS d, sum(value) / 0.997::DOUBLE AS v FROM events GROUP BY 1, 2"


def daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("d")).agg(
        (F.sum("value") / UNTIE).alias("v"))


# -- polygons ---------------------------------------------------------------------------------
def rectangles(t: Tables) -> DataFrame:
    """One rectangle per supplier on a 10-wide lattice, sides from its nation."""
    s = F.col("s_suppkey")
    cx, cy = 100.0 * (s % 10), 100.0 * F.floor(s / 10)
    hx, hy = 20.0 + F.col("s_nationkey"), F.lit(15.0)

    def v(a: int, b: int) -> Column:
        return F.struct((cx + a * hx).alias("x"), (cy + b * hy).alias("y"))

    region = F.concat(F.lit("R"), F.floor((cx + 70) / 500).cast("string"), F.lit("_"),
                      F.floor((cy + 70) / 500).cast("string"))
    return t.supplier.select(s.alias("plot_id"), region.alias("region"),
                             F.array(F.array(v(-1, -1), v(1, -1), v(1, 1), v(-1, 1))).alias("parts"))


RECT = """SELECT s_suppkey AS plot_id, 100.0::DOUBLE * (s_suppkey % 10) AS cx, 100.0::DOUBLE * (s_suppkey // 10) AS cy,
20.0::DOUBLE + s_nationkey AS hx, 15.0::DOUBLE AS hy FROM supplier"""
