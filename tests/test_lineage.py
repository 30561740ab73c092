"""Reserved columns are found by where they come from."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.operators import gates
from fieldspark.operators.lineage import derived_from


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, 2.0, 5.0), (2, None, 6.0), (3, 4.0, 7.0)], "plot_id long, secret double, open double")


WAYS = {
    "renamed": lambda d: d.withColumnRenamed("secret", "x").select("plot_id", "x"),
    "computed": lambda d: d.select("plot_id", (F.col("secret") * 2 + F.col("open")).alias("x")),
    "through steps": lambda d: d.select("plot_id", F.col("secret").alias("a")).select("plot_id", (F.col("a") + 1).alias("x")),
    "aggregated": lambda d: d.groupBy("plot_id").agg(F.max("secret").alias("x")),
    "window": lambda d: d.select("plot_id", F.sum("secret").over(Window.orderBy("plot_id")).alias("x")),
    "joined": lambda d: d.select("plot_id").join(d.select("plot_id", F.col("secret").alias("x")), "plot_id"),
    "second of a union": lambda d: d.select("plot_id", F.col("open").alias("x")).union(d.select("plot_id", "secret")),
    "generated": lambda d: d.select("plot_id", F.explode(F.array("secret")).alias("x")),
    "packed": lambda d: d.select("plot_id", F.struct("secret", "open").alias("x")),
    "named so": lambda d: d.select("plot_id", F.col("open").alias("SECRET")),
    "by python": lambda d: d.select("plot_id", "secret").mapInPandas(lambda fs: (f.rename(columns={"secret": "x"}) for f in fs), "plot_id long, x double"),
    "twice a name": lambda d: d.select(F.col("open").alias("x"), F.col("secret").alias("x")),
}


@pytest.mark.parametrize("way", WAYS)
def test_found(base, way):
    assert 1 in derived_from(WAYS[way](base), ["secret"])["secret"]
    exposed = gates.reserved_gate(WAYS[way](base), ["secret"], "backtest", ["validate"])
    with pytest.raises(gates.GateError, match="secret_exposed"):
        gates.require(exposed)
    assert gates.require(gates.reserved_gate(WAYS[way](base), ["secret"], "validate", ["validate"])) == {"secret_exposed": 0}


def test_scalar_subquery(spark, base):
    base.createOrReplaceTempView("lineage_base")
    d = spark.sql("SELECT plot_id, (SELECT max(secret) FROM lineage_base) AS x FROM lineage_base")
    assert derived_from(d, ["secret"]) == {"secret": [1]}


def test_left_alone(base):
    clean = base.where("secret > 1").drop("secret").withColumn("x", F.col("open") + 1)
    assert derived_from(clean, ["secret", "absent"]) == {"secret": [], "absent": []}
    assert gates.require(gates.reserved_gate(clean, ["secret"], "backtest", [])) == {"secret_exposed": 0}
    both = base.select("plot_id", "open").union(base.select("plot_id", "open"))
    assert derived_from(both, ["secret"]) == {"secret": []}


def test_values_are_counted_over_all_columns(base):
    d = base.withColumn("more", F.col("secret") * 3)
    assert gates.reserved_gate(d, ["secret", "open"], "backtest", []).first().asDict() == {"secret_exposed": 4, "open_exposed": 3}
