"""Sources and sinks. Every schema is declared; nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: daily records at or below this are fill values.
FILL_LIMIT = -900.0

CATALOGUE_SCHEMA = (
    "features ARRAY<STRUCT<id: STRING, properties: STRUCT<datetime: STRING, `eo:cloud_cover`: DOUBLE>,"
    " assets: MAP<STRING, STRUCT<href: STRING>>>>")


def read_labels(spark: SparkSession, path: str, schema: str, columns: Mapping[str, str]) -> DataFrame:
    """Label CSV: only the wanted columns are parsed, under new names."""
    return spark.read.schema(schema).csv(path, header=True).select(
        *[F.col(old).alias(new) for old, new in columns.items()])


def read_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scene catalogue, one row per scene; a missing cloud cover counts as 100."""
    docs = spark.read.schema(CATALOGUE_SCHEMA).json(path, multiLine=multi_line)
    f = docs.select(F.explode("features").alias("f"))
    return f.select(
        F.col("f.id").alias("id"), F.to_date(F.substring("f.properties.datetime", 1, 10)).alias("d"),
        F.col("f.properties.datetime").alias("instant"),
        F.coalesce(F.col("f.properties.`eo:cloud_cover`"), F.lit(100.0)).alias("cloud"),
        F.col("f.assets").alias("assets"))


def least_cloudy_first(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy("cloud", "d", "id")


def read_daily(spark: SparkSession, path: str, parameter: str = "parameter") -> DataFrame:
    """JSON maps ``yyyyMMdd -> amount`` to (source, d, v); a fill value fails the job."""
    text = spark.read.text(path)
    doc = text.select(F.from_json("value", f"source STRING, {parameter} MAP<STRING, DOUBLE>").alias("j"))
    days = doc.select(F.col("j.source").alias("source"), F.explode(f"j.{parameter}").alias("k", "v"))
    checked = F.when(F.col("v") <= FILL_LIMIT, F.raise_error(
        F.concat(F.lit("fill value at "), F.col("k"))).cast("double")).otherwise(F.col("v"))
    return days.select("source", F.to_date("k", "yyyyMMdd").alias("d"), checked.alias("v"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Measured cells of a grid; nodata zeros are filtered in the scan."""
    return spark.read.schema("pass BIGINT, r BIGINT, c BIGINT, value DOUBLE").parquet(path).where("value > 0")


PLOT_SCHEMA = ("plot_id BIGINT, region STRING, parts ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>")


def read_plots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PLOT_SCHEMA).format(fmt).load(path)


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, value): one row per line, or per file when ``whole``."""
    return spark.read.text(path, wholetext=whole).select(
        F.col("_metadata.file_name").alias("file"), "value")


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Persist a stage's frame and read it back under the same schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_window(df: DataFrame, path: str, columns: Sequence[str] = ("window",)) -> None:
    """Write one window's rows and leave the partitions of other windows alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *columns).parquet(path)


OFFSET_SCHEMA = "pass BIGINT, measured DOUBLE, applied DOUBLE"


def write_offsets(offsets: DataFrame, path: str) -> None:
    offsets.select("pass", "measured", "applied").write.mode("overwrite").parquet(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Measured offsets; a missing table is an error and never means zero."""
    try:
        return spark.read.schema(OFFSET_SCHEMA).parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}: offsets are measured, not assumed; run the diagnostics first") from e
