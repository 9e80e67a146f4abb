"""Date-partitioned tables: upsert, overwrite, ledger and key lookups.

Plain Parquet has no transactions, so a partition is replaced by dynamic
overwrite after its merged content has been written to the shared folder: a
lost executor re-reads files, never a half-overwritten source.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import dedup_last
from ..session import materialise

PARTITION = "trade_date"


def table_exists(spark: SparkSession, path: str) -> bool:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def _schema_path(spark: SparkSession, path: str):
    side = spark._jvm.org.apache.hadoop.fs.Path(path, "_columns.json")  # readers skip names with an underscore
    return side, side.getFileSystem(spark._jsc.hadoopConfiguration())


def table_schema(spark: SparkSession, path: str) -> T.StructType:
    """All columns a table has: from its side file, or from the footers of all its files where there is none yet."""
    side, fs = _schema_path(spark, path)
    if not fs.exists(side):
        return spark.read.option("mergeSchema", "true").parquet(path).schema
    stream = fs.open(side)
    try:
        return T.StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def _note_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Widen the side file by columns it lacks."""
    side, fs = _schema_path(spark, path)
    known = table_schema(spark, path) if fs.exists(side) else T.StructType([])
    wide = T.StructType([*known.fields, *[f for f in schema.fields if f.name not in known.names]])
    if wide != known:
        stream = fs.create(side, True)
        stream.write(json.dumps(wide.jsonValue()).encode())
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table with all columns any of its files has, without opening them for their schema."""
    return spark.read.schema(table_schema(spark, path)).parquet(path)


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str] = (PARTITION,),
                     sort: Sequence[str] = ("timestamp",)) -> None:
    """Replace exactly the partitions present in ``df``.

    The rebalance hint brings each partition together in as few files as the
    advised size allows and splits a heavy day over several tasks.
    """
    spark = df.sparkSession
    known = table_schema(spark, path) if table_exists(spark, path) else None  # before files with other columns come
    (df.hint("rebalance", *[F.col(c) for c in partitions])
     .sortWithinPartitions(*partitions, *sort)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))
    if known is not None:
        _note_schema(spark, path, known)
    _note_schema(spark, path, df.schema)


def overwrite_partition(df: DataFrame, path: str, **kw) -> None:
    write_partitions(df, path, **kw)


def merge_last_wins(old: DataFrame | None, new: DataFrame, keys: Sequence[str],
                    arrival: Sequence[str]) -> DataFrame:
    """Union of stored and arriving rows with the columns of both, the last arrival per key.

    ``arrival`` orders the rows of one batch; without an order there is no last one.
    """
    if not arrival:
        raise ValueError("name the columns that order the arrivals of a batch")
    if old is None:
        both = new.withColumn("_batch", F.lit(1))
    else:
        both = old.withColumn("_batch", F.lit(0)).unionByName(
            new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return dedup_last(both, keys, ["_batch", *arrival]).drop("_batch")


def stored_partitions(like: DataFrame, path: str, partitions: Sequence[str]) -> DataFrame:
    """The rows of a table in the partitions that ``like`` has, with all columns the table has.

    Only the folders of the first partition column's values are read; they are calendar
    days, so their number is bounded.  The columns come from the table's side file.
    """
    spark, first = like.sparkSession, partitions[0]
    schema, kinds = table_schema(spark, path), dict(like.dtypes)
    days = [r[0] for r in like.select(F.col(first).cast("string")).distinct().collect()]
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f"{path}/{first}=" + ("__HIVE_DEFAULT_PARTITION__" if d in (None, "") else escape(d)) for d in days]
    folders = [f for f in folders if table_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema).withColumns({p: F.col(p).cast(kinds[p]) for p in partitions})
    # partition columns as text, so that every value is read as it was written
    typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name in partitions else f for f in schema.fields])
    stored = spark.read.option("basePath", path).schema(typed).parquet(*folders)
    stored = stored.withColumns({p: F.col(p).cast(kinds[p]) for p in partitions})
    return stored if len(partitions) == 1 else stored.join(like.select(*partitions).distinct(), list(partitions), "left_semi")


def upsert_partitions(df: DataFrame, path: str, keys: Sequence[str], arrival: Sequence[str],
                      partitions: Sequence[str] = (PARTITION,), sort: Sequence[str] = ("timestamp",)) -> None:
    """Merge into the touched partitions only; the last arrival wins, stored columns that a batch lacks stay.

    The batch is written once to the shared folder, since it is read for its days and for the merge.
    """
    spark = df.sparkSession
    df = materialise(df, "batch")
    old = stored_partitions(df, path, partitions) if table_exists(spark, path) else None
    merged = merge_last_wins(old, df, [*partitions, *keys], arrival)
    if old is not None:
        merged = materialise(merged, "upsert")
    write_partitions(merged, path, partitions, sort)


def existing_keys(df: DataFrame, stored: DataFrame, keys: Sequence[str], present: bool = True) -> DataFrame:
    return df.join(stored.select(*keys), list(keys), "left_semi" if present else "left_anti")


def pending(dates: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("source", "date")) -> DataFrame:
    """Partitions not yet recorded as done."""
    return dates.join(ledger.select(*keys), list(keys), "left_anti")


def record_done(done: DataFrame, ledger_path: str) -> None:
    done.write.mode("append").parquet(ledger_path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partitions: Sequence[str] = ()) -> None:
    """Parquet (snappy), CSV with header or JSON lines."""
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.option("compression", "snappy").parquet(path)
