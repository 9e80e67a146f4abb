"""Forward-looking labels and price vectors over bars on a time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import SERIES
from ..functions.numeric import count_if

MINUTE_MS = 60_000
# Label defaults.
GAIN_THRESHOLD_PCT = 20.0
HORIZON_MINUTES = 120


def forward_labels(bars: DataFrame, threshold: float = GAIN_THRESHOLD_PCT, horizon: int = HORIZON_MINUTES,
                   by: Sequence[str] = SERIES, ts: str = "ts_ms", close: str = "close",
                   with_loss: bool = True) -> DataFrame:
    """Best gain, minutes to its first bar and (optionally) worst change within the horizon.

    One range frame over (0, horizon]; bars must be unique per series and
    timestamp, so a frame holds at most horizon/grid rows.
    """
    ahead = (Window.partitionBy(*by).orderBy(ts)
             .rangeBetween(1, horizon * MINUTE_MS))
    price = F.col(close)
    # the earliest of equal maxima: order by price, then by the negated time
    best = F.max(F.when(price.isNotNull(), F.struct(price.alias("p"), (-F.col(ts)).alias("t")))).over(ahead)
    out = bars.withColumn("_best", best)
    entry_ok = price > 0
    if with_loss:
        worst = F.min(price).over(ahead)
        out = out.withColumn("min_loss_120m", F.when(entry_ok, (worst - price) / price * 100))
    gain = F.when(entry_ok, (F.col("_best.p") - price) / price * 100)
    out = (
        out.withColumn("max_gain_120m", gain)
        .withColumn("time_to_max_min",
                    F.when(F.col("max_gain_120m").isNotNull(),
                           (-F.col("_best.t") - F.col(ts)) / float(MINUTE_MS)))
        .withColumn("target", F.when(F.col("max_gain_120m") >= threshold, 1).otherwise(0).cast("byte"))
    )
    return out.drop("_best")


def label_stats(labeled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    pos = count_if(F.col("target") == 1)
    covered = F.count("max_gain_120m")
    return labeled.groupBy(*by).agg(
        n.alias("total_rows"), pos.alias("positives"), (n - pos).alias("negatives"),
        (pos / n).alias("positive_rate"), (covered / n * 100).alias("coverage_pct"),
        F.max("max_gain_120m").alias("max_gain_pct"), F.avg("max_gain_120m").alias("mean_gain_pct"),
    )


def future_price_vector(bars: DataFrame, steps: int = 120, step_ms: int = MINUTE_MS,
                        by: Sequence[str] = SERIES, ts: str = "ts_ms", close: str = "close",
                        name: str = "target_future_prices") -> DataFrame:
    """array<double>: the price exactly k steps ahead for k = 1..steps, NULL where missing.

    A frame of the times up to ``steps`` ahead keeps one price per grid time, so
    the collected list is bounded by the rows of that span.  It is ordered, so each
    price fills the gap since the one before it: linear in ``steps``.  Of bars that
    share a time the last close by value counts, and each gets the vector.
    """
    grid = bars.groupBy(*by, ts).agg(F.max(close).alias("_v"))
    ahead = Window.partitionBy(*by).orderBy(ts).rangeBetween(1, steps * step_ms)
    near = F.collect_list(F.struct(F.col(ts).alias("k"), F.col("_v").cast("double").alias("v"))).over(ahead)
    exact = F.transform(F.filter("_near", lambda x: F.pmod(x["k"] - F.col(ts), F.lit(step_ms)) == 0),
                        lambda x: F.struct(((x["k"] - F.col(ts)) / step_ms).cast("int").alias("n"), x["v"].alias("v")))
    nothing = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    before = lambda i: F.coalesce(F.get("_at", i - 1)["n"], F.lit(0))
    pieces = F.transform("_at", lambda x, i: F.concat(nothing(x["n"] - before(i) - 1), F.array(x["v"])))
    vector = F.concat(F.flatten(pieces), nothing(F.lit(steps) - before(F.size("_at"))))
    ready = grid.withColumn("_near", near).withColumn("_at", exact).select(*by, ts, vector.alias(name))
    return bars.join(ready, [*by, ts], "left").withColumn(name, F.when(F.col("ticker").isNotNull(), F.col(name)))


def target_coverage_filter(df: DataFrame, min_pct: float = 50.0,
                           name: str = "target_future_prices") -> DataFrame:
    """Rows whose vector is at least ``min_pct`` percent filled."""
    filled = F.size(F.filter(name, lambda x: x.isNotNull()))
    return df.where(F.col("ticker").isNotNull() & (filled * 100.0 / F.size(name) >= min_pct))


def feature_run_stats(features: DataFrame) -> DataFrame:
    """Dates, rows, contract-days and positive rate of a feature run; no rate without labels."""
    positives = count_if(F.col("target") == 1) if "target" in features.columns else F.max(F.lit(None).cast("long"))
    daily = features.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("contracts"), positives.alias("pos"))
    return daily.agg(
        F.count(F.lit(1)).alias("dates_processed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("contracts"), F.lit(0)).alias("total_contracts"), (F.sum("pos") / F.sum("n")).alias("positive_rate"))


def prep_stats(before: DataFrame, after: DataFrame, by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Rows in, out and filtered, with contracts kept, per day."""
    rows_in = before.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_in"))
    rows_out = after.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_out"),
                                      F.count_distinct("ticker").alias("distinct_options"))
    return (rows_in.join(rows_out, list(by), "left").fillna(0, ["rows_out", "distinct_options"])
            .withColumn("rows_filtered", F.col("rows_in") - F.col("rows_out")))
