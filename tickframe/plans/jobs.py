"""Jobs that write their table by day and return the written rows with their statistics.

Statistics are taken from the files just written, so a feature plan runs once and
the figures describe what readers will find.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.bars import consolidation_stats
from ..operators.labels import feature_run_stats, prep_stats
from ..sources.tables import PARTITION, read_table, write_partitions


class Written(NamedTuple):
    """The rows a job wrote, read back from its table, and its statistics."""

    rows: DataFrame
    stats: DataFrame


def between(day: Column, start: str | None, end: str | None) -> Column:
    """Days from ``start`` to ``end``, both included; an open side takes all."""
    return (day >= start if start else F.lit(True)) & (day <= end if end else F.lit(True))


def write_days(df: DataFrame, path: str, sort: Sequence[str] = ("ts_ms",), partition: str = PARTITION) -> DataFrame:
    """Replace the days of ``df`` in a table; the rows of exactly these days as they were written.

    The days are observed while they are written; they are calendar days, so their
    number is bounded.  Rows without a day are a partition of their own.  A plan that
    turns out empty reports nothing observed; its days, if any, are then looked up.
    """
    seen, day = Observation(), F.coalesce(F.col(partition), F.lit(""))
    write_partitions(df.observe(seen, F.collect_set(day).alias("days")), path, (partition,), sort)
    try:
        days = list(seen.get["days"])
    except Py4JJavaError:
        days = [r[0] for r in df.select(day).distinct().collect()]
    return read_table(df.sparkSession, path).where(day.isin(days))


def run_consolidation(table: DataFrame, path: str) -> Written:
    """Write a consolidated table; rows, minutes, contracts and present sources per day."""
    rows = write_days(table, path)
    return Written(rows, consolidation_stats(rows))


def run_features(table: DataFrame, path: str, start: str | None = None, end: str | None = None) -> Written:
    """Write a feature table of the days wanted; one row of statistics for the run.

    ``dates_skipped`` counts the calendar days of the range without any row; it is
    NULL for an open range.
    """
    rows = write_days(table.where(between(F.col(PARTITION), start, end)), path)
    stats = feature_run_stats(rows)
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1 if start and end else F.lit(None)
    return Written(rows, stats.withColumn("dates_skipped", span.cast("long") - F.col("dates_processed")))


def run_preparation(bars: DataFrame, prepared: DataFrame, path: str) -> Written:
    """Write prepared training rows; rows in, out and filtered per day of ``bars``."""
    rows = write_days(prepared, path)
    return Written(rows, prep_stats(bars, rows))
