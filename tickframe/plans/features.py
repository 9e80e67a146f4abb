"""Feature tables for equities, options and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import contracts as con
from ..functions import indicators as ind
from ..functions.numeric import ratio
from ..functions.pricing import implied_vol
from ..operators.asof import asof_grid
from ..operators.bars import MINUTE_MS
from ..operators.labels import future_price_vector, forward_labels, target_coverage_filter
from .consolidate import DAY, prefixed

# Feature windows.
LAG_WINDOWS = (1, 5, 10, 15)
RETURN_WINDOWS = (1, 5, 15, 30, 60)
VOLATILITY_WINDOWS = (5, 30)
EMA_SPANS = (9, 21)
CLOCK = ("hour_et", "minute_et", "minute_of_day", "minutes_since_open", "is_morning", "pct_day_elapsed", "is_last_hour")


def engineer_equity(bars: DataFrame, windows: Sequence[int] = LAG_WINDOWS) -> DataFrame:
    """Gated percent changes of close and, where present, volume."""
    w = ind.series_window()
    out = bars.withColumn("minutes_since_open", cal.session_minutes(F.col("ts_ms")))
    changes = [ind.lag_change("close", "price_change", windows, w)]
    if "volume" in bars.columns:
        changes.append(ind.lag_change("volume", "volume_change", windows, w))
    return ind.layered(out, *changes)


def _with_contract(df: DataFrame) -> DataFrame:
    return df.withColumn("_c", con.parse_symbol(F.col("symbol") if "symbol" in df.columns else F.col("ticker"),
                                                F.col("trade_date")))


def _with_iv(df: DataFrame, spot: str) -> DataFrame:
    vol = implied_vol(F.coalesce("close", F.lit(0.0)), F.coalesce(spot, F.lit(0.0)),
                      F.col("_c.strike"), F.col("_c.tte_days"), F.col("_c.flag") == "c")
    return df.withColumn("implied_volatility", vol)


def engineer_options(bars: DataFrame, underlying: DataFrame, grid_ms: int = MINUTE_MS,
                     windows: Sequence[int] = LAG_WINDOWS) -> DataFrame:
    """Option bars with the underlying price, IV, gated changes and change since the first bar."""
    spot = underlying.select("trade_date", "ts_ms", F.col("close").alias("spy_close"))
    out = asof_grid(bars, spot, grid_ms).withColumn("minutes_since_open", cal.session_minutes(F.col("ts_ms")))
    out = _with_iv(_with_contract(out), "spy_close").drop("_c")
    w = ind.series_window()
    return ind.layered(
        out, ind.lag_change("close", "price_change", windows, w),
        ind.lag_change("implied_volatility", "iv_change", windows, w),
        [{"price_change_open": ind.change_from_first("close", w),
          "iv_change_open": ind.change_from_first("implied_volatility", w)}])


def underlying_features(bars: DataFrame, prefix: str = "spy") -> DataFrame:
    """Per-day features of the underlying, keyed by (trade_date, ts_ms).

    Warm-up gaps of the technical columns are filled from later bars of the day.
    """
    p = lambda c: f"{prefix}_{c}"
    w = ind.series_window(DAY)
    close, volume, vwap = p("close"), p("volume"), F.col(p("vwap"))
    stds = {n: p(f"vol_std_{n}m") for n in VOLATILITY_WINDOWS}
    ranges = {n: p(f"hl_range_{n}m") for n in VOLATILITY_WINDOWS}
    emas = [p(f"ema_{s}") for s in EMA_SPANS]
    technical = [p("rsi_14"), *emas, *[p(c) for c in (
        "ema_diff", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_pct_b")]]
    direct = {
        p("bar_count"): ind.bar_counter(w), p("vol_zscore"): ind.rolling_zscore(volume, 30, 5, w),
        p("vwap_dist_pct"): ratio(F.col(close) - vwap, vwap) * 100,
        **{name: ind.hl_range(p("high"), p("low"), close, n, w) for n, name in ranges.items()}}
    means = ind.beside(*[ind.ema(close, s, name, w) for s, name in zip(EMA_SPANS, emas, strict=True)])
    measured = ind.beside(
        [direct], ind.log_return(close, p("return"), RETURN_WINDOWS, w),
        ind.rolling_mean(volume, 5, p("vol_ma5"), w, p("vol_ratio_5m")),
        ind.rolling_mean(volume, 30, p("vol_ma30"), w, p("vol_ratio_30m")),
        ind.return_volatility(close, stds, w), ind.rsi(close, p("rsi_14"), w),
        ind.after(means, [{p("ema_diff"): F.col(emas[0]) - F.col(emas[1])}]),
        ind.macd(close, p("macd"), p("macd_signal"), p("macd_hist"), w), ind.bollinger(close, p("bb"), w))
    finished = ind.after(ind.blank_short(technical, max(ind.MACD_SLOW, ind.RSI_PERIOD), w),
                         ind.fill_both_ways([*technical, *stds.values(), *ranges.values()], w))
    df = cal.add_clock_features(prefixed(bars, prefix))
    return ind.layered(df, ind.after(measured, finished)).drop(p("bb_middle"), p("bb_width"))


def option_features(df: DataFrame, prefix: str = "spy") -> DataFrame:
    """Option-side and cross-asset features on bars that already carry the underlying's."""
    w = ind.series_window()
    spot, strike, tte = F.col(f"{prefix}_close"), F.col("_c.strike"), F.col("_c.tte_days")
    out = _with_iv(_with_contract(df), f"{prefix}_close").withColumns({
        "strike": strike, "contract_type": con.call_flag(F.col("_c.flag")), "time_to_expiry_days": tte,
        "is_0dte": con.is_0dte(tte), "moneyness": con.moneyness(spot, strike),
        "log_moneyness": con.log_moneyness(spot, strike)}).drop("_c")
    vol = "implied_volatility"
    direct = {
        "opt_price_change_open": ind.change_from_first("close", w),
        "opt_hl_range_5m": ind.hl_range("high", "low", "close", 5, w),
        "iv_change_1m": ind.plain_change(vol, 1, w), "iv_change_5m": ind.plain_change(vol, 5, w),
        "iv_change_open": ind.change_from_first(vol, w), "opt_bar_count": ind.bar_counter(w)}
    opt_rsi = ind.after(ind.rsi("close", "opt_rsi_14", w), ind.after(
        ind.blank_short(["opt_rsi_14"], ind.RSI_PERIOD, w), ind.fill_both_ways(["opt_rsi_14"], w)))
    returns = ind.log_return("close", "opt_return", RETURN_WINDOWS, w)
    return ind.layered(out, [direct], ind.rolling_mean("volume", 5, "opt_vol_ma5", w, "opt_vol_ratio_5m"), opt_rsi,
                       ind.after(returns, [cross_asset(prefix)]))


def cross_asset(prefix: str = "spy") -> dict[str, Column]:
    """Ratios of the option to the underlying and to its own day."""
    p = lambda c: F.col(f"{prefix}_{c}").cast("double")
    w, vwap = ind.series_window(), F.col("vwap")
    return {
        f"opt_vs_{prefix}_return_1m": F.col("opt_return_1m") - p("return_1m"),
        "opt_vwap_dist_pct": ratio(F.col("close") - vwap, vwap) * 100,
        f"{prefix}_vol_regime": ratio(p("volume"), p("vol_ma30")),
        "opt_vol_pct_cumday": ind.cumulative_share("volume", w),
        "transactions_ratio": ratio(F.col("transactions").cast("double"), p("transactions")),
    }


def engineer_ml_features(option_bars: DataFrame, underlying_bars: DataFrame, prefix: str = "spy",
                         threshold: float = 20.0, horizon: int = 120, grid_ms: int = MINUTE_MS) -> DataFrame:
    """The model table: underlying features as-of each option bar, option features, labels.

    The underlying side is computed once for all contracts of a day.
    """
    joined = asof_grid(option_bars, underlying_features(underlying_bars, prefix), grid_ms)
    labelled = forward_labels(option_features(joined, prefix), threshold, horizon)
    return labelled.withColumns({"date": F.col("trade_date"), "opt_close": F.col("close")})


def prepare_training(bars: DataFrame, steps: int = 120, step_ms: int = 60_000, min_pct: float = 50.0) -> DataFrame:
    """Future price vectors of sufficiently covered bars."""
    return target_coverage_filter(future_price_vector(bars, steps, step_ms), min_pct)
