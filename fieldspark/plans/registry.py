"""Registered queries: an operator bound to the given tables, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given parquet tables, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(key: str, sql: str | None = None, f: str = "", nd: int = 6, cast: str = ""):
    """Register ``fn(tables)`` under ``key``; the columns in ``f`` are rounded on both sides.

    ``cast`` lists ``column:TYPE`` of the SQL where its literal types are not Spark's.
    """
    floats = f.split()

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(spark, folder))
            return df.withColumns({c: F.round(F.col(c).cast("double"), nd) + 0.0
                                   for c in floats}) if floats else df

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            items = [f"round({c}::DOUBLE, {nd}) + 0 AS {c}" for c in floats]
            items += ["{0}::{1} AS {0}".format(*c.split(":")) for c in cast.split()]
            ORACLE[key] = f"SELECT * REPLACE ({', '.join(items)}) FROM ({sql}) t" if items else sql
        return fn

    return register
