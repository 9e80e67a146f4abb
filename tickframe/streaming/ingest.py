"""Streaming ingest: validate, deduplicate and upsert micro-batches."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.calendar import market_open, partition_date
from ..operators.monitoring import ingest_stats
from ..operators.quality import RuleSet, split_valid, validate
from ..session import materialise, scratch_path
from ..sources.tables import upsert_partitions
from .state import keyed_state

METRICS = "operation string, batch_id long, seconds double, records long, rejected long, ended_ms long"
LEDGER = "batch_id long, mark long, newest long, arrived long, accepted long, late long"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New files of a landing folder, oldest first."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def market_hours_gate(stream: DataFrame, ts: str = "timestamp", holidays: Sequence[str] = ()) -> DataFrame:
    return stream.where(market_open(F.col(ts), holidays))


def bounded_dedup(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """First arrival per key within the watermark; state is dropped as it passes."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest(stream: DataFrame, source: str | RuleSet, table: str, keys: Sequence[str] = ("timestamp",), *, arrival: Sequence[str],
           checkpoint: str | None = None, stats_path: str | None = None, rejects_path: str | None = None,
           available_now: bool = True) -> StreamingQuery:
    """Write the valid rows of a bar stream to a date-partitioned table, last arrival wins.

    Rows are valid by the rules of ``source``, which may also be a rule set of the caller.
    A batch that is replayed after a failure merges to the same table content.
    """
    def flush(batch: DataFrame, batch_id: int) -> None:
        batch = materialise(batch, "batch")  # read for the table, the counts and the rejects
        good, bad = split_valid(batch, source)
        dated = good.withColumn("trade_date", partition_date(F.col("timestamp")))
        upsert_partitions(dated, table, keys, arrival)
        if stats_path:
            stats = ingest_stats(validate(batch, source), keys).withColumn("batch_id", F.lit(batch_id))
            stats.write.mode("overwrite").parquet(f"{stats_path}/batch={batch_id}")
        if rejects_path:
            bad.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")

    return start_batches(stream, flush, checkpoint, available_now)


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None,
                  available_now: bool = True, mode: str = "append") -> StreamingQuery:
    spot = checkpoint or scratch_path(stream.sparkSession, "checkpoint")
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", spot)
    with keyed_state(stream.sparkSession, stream):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_options(stream: DataFrame, table: str, **kw) -> StreamingQuery:
    """Option bars are keyed by contract and timestamp."""
    return ingest(stream, "options", table, ("ticker", "timestamp"), **kw)


def append_to(stream: DataFrame, path: str, checkpoint: str | None = None, name: str | None = None) -> StreamingQuery:
    """Append finalised rows of a stream to a table until the input is used up."""
    spot = checkpoint or scratch_path(stream.sparkSession, "checkpoint")
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", spot)
    with keyed_state(stream.sparkSession, stream):
        return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()


class BatchLog(StreamingQueryListener):
    """Appends one row of duration and volume to ``path`` for each batch of the stream ``name`` that read rows.

    ``records`` and ``rejected`` are observed in the batch itself, so nothing is read again.  A replayed batch replaces its row.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, operation: str = "stream"):
        self.spark, self.path, self.name, self.operation = spark, path, name, operation
        self.run, self.failed, self.ended = None, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("flow") if p.name == self.name else None
        if seen is None or not seen["records"]:
            return
        ended = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() * 1000 + p.batchDuration
        row = [(self.operation, p.batchId, p.batchDuration / 1000, seen["records"], seen["rejected"], int(ended))]
        try:
            self.spark.createDataFrame(row, METRICS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={p.batchId}")
        except Exception as e:  # a listener's own errors are not seen by the query
            self.failed = e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()

    def finish(self, seconds: float = 60) -> None:
        """Wait until the log of an ended stream is whole."""
        if not self.ended.wait(seconds) or self.failed:
            raise RuntimeError(f"the log of {self.name} is not whole") from self.failed
        self.spark.streams.removeListener(self)


def append_measured(stream: DataFrame, path: str, metrics: str, rejected: Column | None = None, operation: str = "stream",
                    checkpoint: str | None = None) -> tuple[StreamingQuery, BatchLog]:
    """Append the rows that are not rejected to ``path`` and one row a batch to ``metrics``, see ``BatchLog``."""
    spark, name = stream.sparkSession, f"{operation}-{uuid.uuid4().hex}"
    bad = F.coalesce(rejected, F.lit(False)) if rejected is not None else F.lit(False)
    seen = stream.withColumn("_bad", bad).observe("flow", F.count(F.lit(1)).alias("records"), F.count_if("_bad").alias("rejected"))
    log = BatchLog(spark, metrics, name, operation)
    spark.streams.addListener(log)
    return append_to(seen.where(~F.col("_bad")).drop("_bad"), path, checkpoint, name), log


def keep_current(stream: DataFrame, path: str, keys: Sequence[str], ts: str, checkpoint: str | None = None) -> StreamingQuery:
    """The present state of each window of an update-mode aggregate, in a table partitioned by the UTC day of ``ts``.

    Each batch replaces the windows it changed, so open windows are in the table at any time and an input may
    end, pause or go on without a sign.  A batch that is replayed writes the same rows again.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("trade_date", partition_date(F.col(ts)))
        upsert_partitions(dated, path, keys, list(keys), sort=[ts])  # a batch has a window once

    return start_batches(stream, merge, checkpoint, mode="update")


def route_late(stream: DataFrame, accepted: str, late: str, ledger: str, ts: str, delay_ms: int, checkpoint: str | None = None) -> StreamingQuery:
    """Part the rows of each batch as they arrive: those older than the mark go to ``late``, all others to ``accepted``.

    The mark is the newest time of all earlier batches less ``delay_ms``.  ``ledger`` has one row a batch: (batch_id,
    mark, newest, arrived, accepted, late), and only the row before is read.  All three are folders by
    batch, which a replayed batch replaces.  Rows without a time are accepted.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialise(batch, "batch")  # parted and counted
        before = spark.read.schema(LEDGER).parquet(f"{ledger}/batch={batch_id - 1}").head() if batch_id else None
        newest = before["newest"] if before else None
        mark = newest - delay_ms if newest is not None else None
        old = F.coalesce(F.col(ts) < F.lit(mark).cast("long"), F.lit(False))
        got = batch.agg(F.max(ts), F.count(F.lit(1)), F.count_if(old)).head()
        batch.where(~old).write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        batch.where(old).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        newest = max((x for x in (newest, got[0]) if x is not None), default=None)
        row = [(batch_id, mark, newest, got[1], got[1] - got[2], got[2])]
        spark.createDataFrame(row, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return start_batches(stream, write, checkpoint)


def incremental(stream: DataFrame, since_ms: int | None, ts: str = "timestamp") -> DataFrame:
    """Records newer than a high-water mark (all without one); the checkpoint keeps the rest of the position."""
    return stream if since_ms is None else stream.where(F.col(ts) > since_ms)


def high_water_mark(stored: DataFrame, ts: str = "timestamp") -> int | None:
    """The newest time in a stored table."""
    return stored.agg(F.max(ts)).head()[0]


def lay_out(table: DataFrame, path: str, order: str = "ts_ms", mode: str = "append") -> None:
    """Land a table as files of consecutive time ranges, sorted inside."""
    (table.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode(mode).parquet(path))


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A landed table as a stream, a few time ranges per batch."""
    return file_stream(spark, path, schema, files_per_trigger)


def late_rows(arrivals: DataFrame, batch: str, ts: str, delay_ms: int) -> DataFrame:
    """Rows a stateful operator would drop: older than the watermark left by earlier batches.

    The same over landed batches: they are compared with the running maximum of the
    batches before them (one row per batch).  ``route_late`` parts them as they arrive.
    """
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = (arrivals.groupBy(batch).agg(F.max(ts).alias("_max"))
             .select(batch, (F.max("_max").over(before) - delay_ms).alias("_mark")))
    return arrivals.join(marks, batch).where(F.col(ts) < F.col("_mark")).drop("_mark")
