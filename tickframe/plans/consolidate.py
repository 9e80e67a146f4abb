"""Raw ticks to the enriched per-minute, per-contract table, all days in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.pricing import RISK_FREE, add_greeks
from ..operators.asof import asof_bars
from ..operators.bars import MINUTE_MS, resample_ohlc, resample_ohlcv, resample_options
from ..operators.flatten import flatten_with_fallback, option_rows

# Consolidation defaults.
MOMENTUM_WINDOWS = (5, 30, 60)
NEWS_LOOKBACK_MS = 24 * 3_600_000
MIN_BARS = max(ind.MACD_SLOW, ind.BB_PERIOD) + 10
DAY = ("trade_date",)


def prefixed(bars: DataFrame, prefix: str, keep: Sequence[str] = ("trade_date", "ts_ms")) -> DataFrame:
    return bars.select(*keep, *[F.col(c).alias(f"{prefix}_{c}") for c in bars.columns if c not in keep])


def align_index(underlying: DataFrame, index_bars: DataFrame, prefix: str = "vix",
                grid_ms: int = MINUTE_MS) -> DataFrame:
    """Last index bar at or before each underlying bar of the same day."""
    return asof_bars(underlying, prefixed(index_bars, prefix), grid_ms, DAY)


def indicator_layers(prefix: str = "spy", min_bars: int = MIN_BARS) -> ind.Layers:
    """RSI, MACD and Bollinger columns; all NULL on days with too few bars."""
    w, close = ind.series_window(DAY), f"{prefix}_close"
    macd = [f"{prefix}_macd", f"{prefix}_macd_signal", f"{prefix}_macd_histogram"]
    bands = [f"{prefix}_bb_{p}" for p in ("upper", "middle", "lower", "width")]
    measured = ind.beside(ind.rsi(close, f"{prefix}_rsi_14", w), ind.macd(close, *macd, w),
                          ind.bollinger(close, f"{prefix}_bb", w), ind.momentum(close, MOMENTUM_WINDOWS, w, f"{prefix}_"))
    return ind.after(measured, ind.blank_short([f"{prefix}_rsi_14", *macd, *bands], min_bars, w))


def attach_news(df: DataFrame, news: DataFrame, lookback_ms: int = NEWS_LOOKBACK_MS,
                grid_ms: int = MINUTE_MS) -> DataFrame:
    """Latest article at or before each bar, same day and within the lookback."""
    side = news.select("trade_date", "ts_ms", F.col("sentiment").alias("news_sentiment"),
                       F.col("sentiment_reasoning").alias("news_sentiment_reasoning"),
                       F.col("article_id").alias("news_article_id"))
    return asof_bars(df, side, grid_ms, DAY, tolerance=lookback_ms, tie="news_article_id")


def enrich_underlying(ticks: DataFrame, index_ticks: DataFrame, news: DataFrame, width_ms: int = MINUTE_MS,
                      order: str | None = None, prefix: str = "spy", index_prefix: str = "vix",
                      min_bars: int = MIN_BARS) -> DataFrame:
    bars = prefixed(resample_ohlcv(ticks, DAY, width_ms, order=order), prefix)
    bars = align_index(bars, resample_ohlc(index_ticks, DAY, width_ms, order=order), index_prefix, width_ms)
    bars = ind.layered(bars, indicator_layers(prefix, min_bars)).drop(f"{prefix}_bb_pct_b")
    return attach_news(bars, news, grid_ms=width_ms)


def consolidate(ticks: DataFrame, index_ticks: DataFrame, option_ticks: DataFrame, contracts: DataFrame,
                news: DataFrame, width_ms: int = MINUTE_MS, order: str | None = None, prefix: str = "spy",
                index_prefix: str = "vix", min_bars: int = MIN_BARS, rate: float = RISK_FREE) -> DataFrame:
    """The consolidated table; days without option rows keep underlying-only rows."""
    enriched = enrich_underlying(ticks, index_ticks, news, width_ms, order, prefix, index_prefix, min_bars)
    options = option_rows(resample_options(option_ticks, width_ms=width_ms, order=order), contracts)
    flat = flatten_with_fallback(enriched, options)
    return add_greeks(flat, f"{prefix}_close", "option_avg_price", rate).withColumn("source", F.lit("consolidated"))
