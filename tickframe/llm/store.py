"""Intermediate tables in the shared folder, removed as soon as nothing reads them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_RUNS: list[list[str]] = []


def column(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows per Arrow batch while long texts go to Python, for an action inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Run:
    """The tables of one chain of steps: ``release`` removes those that were opened inside of its ``with`` blocks, and no others."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Run:
        _RUNS.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _RUNS.pop()

    def release(self, spark: SparkSession) -> None:
        """Call it only when no unwritten result of the run reads its tables."""
        while self.paths:
            delete(spark, self.paths.pop())


class Store:
    """Named tables under ``spark.checkpoint.dir`` that cut the lineage and survive lost executors.

    They stay until they are dropped, the run around them is released or the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths, self.run = spark, label, {}, _RUNS[-1] if _RUNS else None

    def path(self, name: str) -> str:
        if name not in self.paths:
            self.paths[name] = scratch_path(self.spark, f"{self.label}-{name}")
            if self.run is not None:
                self.run.append(self.paths[name])
        return self.paths[name]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name)
            delete(self.spark, path)
            if self.run is not None:
                self.run.remove(path)
