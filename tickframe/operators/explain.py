"""Reading model contributions: banded feature meanings and top drivers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INF = float("inf")

# Fixed values: (feature, lower bound, upper bound, meaning); lower <= value < upper.
# A bound that belongs to the lower band is written past(bound), the next double above it.
past = lambda bound: math.nextafter(bound, INF)
FEATURE_BANDS: tuple[tuple[str, float, float, str], ...] = (
    ("contract_type", -INF, past(0.5), "put"), ("contract_type", past(0.5), INF, "call"),
    ("time_to_expiry_days", -INF, 1.0, "same day"), ("time_to_expiry_days", 1.0, INF, "multi day"),
    ("is_0dte", -INF, past(0.5), "multi day"), ("is_0dte", past(0.5), INF, "same day"),
    ("moneyness", -INF, 0.97, "deep ITM"), ("moneyness", 0.97, 0.995, "ITM"),
    ("moneyness", 0.995, past(1.005), "ATM"), ("moneyness", past(1.005), past(1.03), "OTM"),
    ("moneyness", past(1.03), INF, "deep OTM"),
    ("log_moneyness", -INF, 0.0, "ITM"), ("log_moneyness", 0.0, INF, "OTM"),
    ("implied_volatility", -INF, 0.15, "low"), ("implied_volatility", 0.15, past(0.40), "moderate"),
    ("implied_volatility", past(0.40), INF, "high"),
    ("iv_change_1m", -INF, past(0.0), "falling"), ("iv_change_1m", past(0.0), INF, "rising"),
    ("iv_change_5m", -INF, past(0.0), "falling"), ("iv_change_5m", past(0.0), INF, "rising"),
    ("iv_change_open", -INF, past(0.0), "falling"), ("iv_change_open", past(0.0), INF, "rising"),
    ("opt_return_1m", -INF, -0.05, "down"), ("opt_return_1m", -0.05, past(0.10), "quiet"),
    ("opt_return_1m", past(0.10), INF, "up"),
    ("opt_return_5m", -INF, -0.05, "down"), ("opt_return_5m", -0.05, past(0.15), "quiet"),
    ("opt_return_5m", past(0.15), INF, "up"),
    ("opt_price_change_open", -INF, -0.10, "down"), ("opt_price_change_open", -0.10, past(0.20), "quiet"),
    ("opt_price_change_open", past(0.20), INF, "up"),
    ("opt_rsi_14", -INF, past(30.0), "oversold"), ("opt_rsi_14", past(30.0), 70.0, "neutral"),
    ("opt_rsi_14", 70.0, INF, "overbought"),
    ("opt_hl_range_5m", -INF, past(0.10), "tight"), ("opt_hl_range_5m", past(0.10), INF, "wide"),
    ("opt_vwap_dist_pct", -INF, past(0.0), "below"), ("opt_vwap_dist_pct", past(0.0), INF, "above"),
    ("opt_vs_spy_return_1m", -INF, past(0.0), "lagging"), ("opt_vs_spy_return_1m", past(0.0), INF, "leading"),
    ("opt_vol_ratio_5m", -INF, past(2.0), "normal"), ("opt_vol_ratio_5m", past(2.0), INF, "surge"),
    ("opt_bar_count", -INF, past(50.0), "early"), ("opt_bar_count", past(50.0), INF, "established"),
    ("transactions_ratio", -INF, past(0.01), "normal"), ("transactions_ratio", past(0.01), INF, "unusual"),
    ("spy_return_1m", -INF, -0.003, "down"), ("spy_return_1m", -0.003, past(0.003), "flat"),
    ("spy_return_1m", past(0.003), INF, "up"),
    ("spy_return_5m", -INF, -0.005, "down"), ("spy_return_5m", -0.005, past(0.005), "flat"),
    ("spy_return_5m", past(0.005), INF, "up"),
    ("spy_hl_range_5m", -INF, past(0.005), "tight"), ("spy_hl_range_5m", past(0.005), INF, "wide"),
    ("spy_hl_range_30m", -INF, past(0.01), "tight"), ("spy_hl_range_30m", past(0.01), INF, "wide"),
    ("spy_rsi_14", -INF, past(30.0), "oversold"), ("spy_rsi_14", past(30.0), 70.0, "neutral"),
    ("spy_rsi_14", 70.0, INF, "overbought"),
    ("spy_macd", -INF, past(0.0), "bearish"), ("spy_macd", past(0.0), INF, "bullish"),
    ("spy_macd_hist", -INF, past(0.0), "bearish"), ("spy_macd_hist", past(0.0), INF, "bullish"),
    ("spy_ema_diff", -INF, past(0.0), "bearish"), ("spy_ema_diff", past(0.0), INF, "bullish"),
    ("spy_bb_pct_b", -INF, 0.2, "oversold"), ("spy_bb_pct_b", 0.2, past(0.8), "mid band"),
    ("spy_bb_pct_b", past(0.8), INF, "overbought"),
    ("spy_vwap_dist_pct", -INF, past(0.0), "below"), ("spy_vwap_dist_pct", past(0.0), INF, "above"),
    ("spy_vol_ratio_5m", -INF, 0.5, "thin"), ("spy_vol_ratio_5m", 0.5, past(2.0), "average"),
    ("spy_vol_ratio_5m", past(2.0), INF, "surge"),
    ("spy_vol_zscore", -INF, -2.0, "abnormal"), ("spy_vol_zscore", -2.0, past(2.0), "normal"),
    ("spy_vol_zscore", past(2.0), INF, "abnormal"),
    ("spy_vol_regime", -0.5, past(0.5), "low"), ("spy_vol_regime", past(0.5), 1.5, "normal"),
    ("spy_vol_regime", 1.5, past(2.5), "high"),
    ("hour_et", -INF, 10.0, "opening"), ("hour_et", 10.0, 12.0, "late morning"),
    ("hour_et", 12.0, 15.0, "midday"), ("hour_et", 15.0, INF, "closing"),
    ("minutes_since_open", -INF, 60.0, "first hour"), ("minutes_since_open", 60.0, past(240.0), "midday"),
    ("minutes_since_open", past(240.0), INF, "afternoon"),
    ("is_morning", -INF, past(0.5), "afternoon"), ("is_morning", past(0.5), INF, "morning"),
    ("is_last_hour", -INF, past(0.5), "earlier"), ("is_last_hour", past(0.5), INF, "last hour"),
    ("pct_day_elapsed", -INF, 0.25, "early"), ("pct_day_elapsed", 0.25, past(0.75), "midday"),
    ("pct_day_elapsed", past(0.75), INF, "late"),
)
# Ranking of contributions.
TOP_IMPACTS = 10
STRENGTH_SCALE, STRENGTH_MAX = 20, 5
NEAR_MARGIN = 0.02
RISK_COUNT = 2


def band_table(spark: SparkSession, bands: Sequence[tuple[str, float, float, str]] = FEATURE_BANDS) -> DataFrame:
    return spark.createDataFrame(list(bands), "feature string, lo double, hi double, meaning string")


def interpret(contributions: DataFrame, bands: Sequence[tuple[str, float, float, str]] = FEATURE_BANDS,
              value: str = "value") -> DataFrame:
    """Adds ``meaning``; features without bands read 'name = value'.

    The band table is a fixed hundred rows, so it is broadcast: equality on the
    feature, range on the value.
    """
    rules = F.broadcast(band_table(contributions.sparkSession, bands).withColumnRenamed("feature", "_f"))
    v = F.col(value)
    out = contributions.join(rules, (F.col("feature") == F.col("_f")) & (v >= F.col("lo")) & (v < F.col("hi")), "left")
    plain = F.concat(F.col("feature"), F.lit(" = "), F.format_string("%.4g", v))
    return out.withColumn("meaning", F.coalesce("meaning", plain)).drop("_f", "lo", "hi")


def row_impacts(impacts: Sequence[str], k: int = TOP_IMPACTS) -> Column:
    """The k strongest contributions of a row as an array of (feature, impact), one column of ``impacts`` a feature."""
    if k >= len(impacts):
        return F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("impact")) for c in impacts])
    # ascending order of these structs is that of abs(impact) DESC, feature: NaN is largest, NULL last
    sized = F.array(*[F.struct(F.col(c).isNull().alias("a"), (~F.isnan(c)).alias("b"), (-F.abs(c)).alias("c"),
                               F.lit(c).alias("feature"), F.col(c).alias("impact")) for c in impacts])
    return F.transform(F.slice(F.array_sort(sized), 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["impact"].alias("impact")))


def top_impacts(signals: DataFrame, by: Sequence[str], impacts: Sequence[str], k: int = TOP_IMPACTS) -> DataFrame:
    """The k strongest contributions per signal with direction and strength.

    ``impacts`` names the contributions, one column a feature.  Rows are shuffled as they are and cut to their own k
    strongest before those of a signal are ranked, so neither the shuffle nor a sort before it holds a row per feature.
    """
    x = F.col("impact")
    w = Window.partitionBy(*by).orderBy(F.abs(x).desc(), "feature")
    met = signals.select(*by, *impacts).repartition(*by)
    return (met.select(*by, F.inline(row_impacts(impacts, k))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("direction", F.when(x > 0, "bullish").otherwise("bearish"))
            .withColumn("is_risk", x < 0)
            .withColumn("strength", F.least(F.lit(STRENGTH_MAX), F.greatest(
                F.lit(1), F.floor(F.abs(x) * STRENGTH_SCALE).cast("int")))))


def signal_cautions(signals: DataFrame, by: Sequence[str], impacts: Sequence[str], threshold: float, k: int = TOP_IMPACTS,
                    score: str = "proba") -> DataFrame:
    """Per signal: margin, near-threshold flag, risks among the k strongest contributions and caution flag.

    Risks are counted inside the row; a signal's rows add up.
    """
    margin = F.max(score) - threshold
    if k >= len(impacts):
        inside = reduce(lambda a, b: a + b, [F.when(F.col(c) < 0, 1).otherwise(0) for c in impacts])
    else:
        inside = F.size(F.filter(row_impacts(impacts, k), lambda x: x["impact"] < 0))
    risks = F.sum(inside)
    return signals.groupBy(*by).agg(
        margin.alias("margin"), (F.abs(margin) < NEAR_MARGIN).alias("near_threshold"),
        risks.alias("risk_factors"), (risks >= RISK_COUNT).alias("caution"))
