"""Session construction and the shared scratch area."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "tickframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator relies on (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``, or one in the session's warehouse, which is shared too."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return root or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared folder, removed when the session's JVM ends."""
    path = os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Used where a result feeds several later passes; unlike a cache the files
    survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
