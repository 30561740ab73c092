"""Stage tables: results written once to shared storage and read back.

A stage table cuts lineage, survives the loss of executors, and gives the optimiser a real file
size, so a later join broadcasts it only when its *measured* size is under
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: the session's checkpoint folder.

    A machine-local folder is used only when the session itself is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def session_folder(spark: SparkSession) -> str:
    """Folder of this application's stage tables."""
    return f"{stage_root(spark)}/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables, once no frame built on them is needed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a fresh stage table and return a scan of it."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/stage-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
