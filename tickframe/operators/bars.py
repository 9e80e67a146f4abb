"""Time-bucket aggregation of ticks into bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import partition_date
from ..functions.numeric import ratio

MINUTE_MS = 60_000


def bucket(ts_ms: Column, width_ms: int = MINUTE_MS) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(width_ms))


def _first(col: str, order: str) -> Column:
    return F.min_by(col, F.when(F.col(col).isNotNull(), F.col(order)))


def _last(col: str, order: str) -> Column:
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col(order)))


def _ohlc(o: str, h: str, l: str, c: str, order: str) -> list[Column]:
    return [_first(o, order).alias("open"), F.max(h).alias("high"),
            F.min(l).alias("low"), _last(c, order).alias("close")]


def _grouped(ticks: DataFrame, by: Sequence[str], width_ms: int, ts: str):
    keyed = ticks.withColumn("_bar", bucket(F.col(ts), width_ms))
    return keyed.groupBy(*by, F.col("_bar").alias("ts_ms"))


def resample_ohlcv(ticks: DataFrame, by: Sequence[str] = ("trade_date",), width_ms: int = MINUTE_MS,
                   ts: str = "ts_ms", order: str | None = None) -> DataFrame:
    """OHLCV bars with volume-weighted price.

    ``order`` is the column that ranks ticks inside a bar (unique per bar,
    by default the timestamp).  The aggregation is partial before its shuffle,
    so a hot instrument costs one row per bar and map task.
    """
    value = F.col("vwap") * F.col("volume")
    return _grouped(ticks, by, width_ms, ts).agg(
        *_ohlc("open", "high", "low", "close", order or ts),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"),
        ratio(F.coalesce(F.sum(value), F.lit(0.0)), F.sum("volume").cast("double")).alias("vwap"),
    )


def resample_ohlc(ticks: DataFrame, by: Sequence[str] = ("trade_date",), width_ms: int = MINUTE_MS,
                  ts: str = "ts_ms", order: str | None = None) -> DataFrame:
    """Price-only bars, for index levels without volume."""
    return _grouped(ticks, by, width_ms, ts).agg(*_ohlc("open", "high", "low", "close", order or ts))


def resample_options(ticks: DataFrame, by: Sequence[str] = ("trade_date", "ticker"),
                     width_ms: int = MINUTE_MS, ts: str = "ts_ms", order: str | None = None) -> DataFrame:
    """Per-contract bars; the mean close comes from the same aggregation."""
    return _grouped(ticks, by, width_ms, ts).agg(
        *_ohlc("open", "high", "low", "close", order or ts),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        F.avg("close").alias("option_avg_price"),
    )


def opening_price(bars: DataFrame, by: Sequence[str] = ("trade_date",), ts: str = "ts_ms") -> DataFrame:
    """Open of the earliest bar of each day."""
    return bars.groupBy(*by).agg(F.min_by("open", ts).alias("opening_price"))


def consolidation_stats(df: DataFrame, index: str = "vix_close") -> DataFrame:
    """Row, minute and contract counts of a consolidated table and the sources present, per trade date."""
    has_index = [(F.count(index) > 0).alias("has_index")] if index in df.columns else []
    return df.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("ts_ms").alias("minutes"),
        F.count_distinct("ticker").alias("contracts"),
        (F.count("ticker") > 0).alias("has_options"),
        (F.count("news_article_id") > 0).alias("has_news"), *has_index,
    )


def with_trade_date(df: DataFrame, ts: str = "ts_ms") -> DataFrame:
    return df.withColumn("trade_date", partition_date(F.col(ts)))
