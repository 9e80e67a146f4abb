"""Windowed streaming aggregates on event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_if, ratio

# Window widths.
HEARTBEAT, STALL = "5 minutes", "15 minutes"
ERROR_WINDOW, ERROR_SLIDE = "15 minutes", "1 minute"


def watermarked(stream: DataFrame, delay: str, ts: str = "ts_ms", event_time: str = "event_time") -> DataFrame:
    """Attach event time and the lateness bound; later rows are dropped by stateful operators."""
    return stream.withColumn(event_time, F.timestamp_millis(F.col(ts))).withWatermark(event_time, delay)


def stream_bars(stream: DataFrame, by: Sequence[str], width: str, order: str = "ts_ms",
                event_time: str = "event_time") -> DataFrame:
    """OHLCV bars of a watermarked tick stream, emitted when closed."""
    value = F.col("vwap") * F.col("volume")
    bars = stream.groupBy(*by, F.window(event_time, width)).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col(order))).alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col(order))).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"),
        ratio(F.coalesce(F.sum(value), F.lit(0.0)), F.sum("volume").cast("double")).alias("vwap"))
    return bars.withColumn("ts_ms", F.unix_millis("window.start")).drop("window")


def heartbeat(stream: DataFrame, by: Sequence[str], width: str = HEARTBEAT, ts: str = "ts_ms",
              event_time: str = "event_time") -> DataFrame:
    """Messages and last message time per interval."""
    beats = stream.groupBy(*by, F.window(event_time, width)).agg(
        F.count(F.lit(1)).alias("messages"), F.max(ts).alias("last_message_ms"))
    return beats.withColumn("beat_ms", F.unix_millis("window.start")).drop("window")


def activity_sessions(stream: DataFrame, by: Sequence[str], gap: str = STALL, event_time: str = "event_time") -> DataFrame:
    """Spans of activity; the time between two spans of a key is a stall."""
    spans = stream.groupBy(*by, F.session_window(event_time, gap)).agg(F.count(F.lit(1)).alias("messages"))
    return spans.select(*by, F.unix_millis("session_window.start").alias("start_ms"),
                        F.unix_millis("session_window.end").alias("end_ms"), "messages")


def error_rate(stream: DataFrame, width: str = ERROR_WINDOW, slide: str = ERROR_SLIDE, limit_pct: float = 1.0,
               is_error: str = "is_error", event_time: str = "event_time") -> DataFrame:
    """Error percentage per sliding window."""
    out = stream.groupBy(F.window(event_time, width, slide)).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col(is_error)).alias("errors"))
    rate = F.col("errors") * 100.0 / F.col("total")
    return out.select(F.unix_millis("window.start").alias("window_ms"), "total", "errors",
                      rate.alias("rate_pct"), (rate > limit_pct).alias("alert"))
