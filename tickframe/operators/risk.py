"""Loss severity of false positives, stop levels and expected value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_if, join_results, ratio
from .quantiles import exact_quantiles
from .ranking import global_position

# Report levels.
STOP_LEVELS = (-5.0, -10.0, -15.0, -20.0, -25.0)
REPORT_STOPS = (-5.0, -10.0, -15.0, -20.0)
DRAWDOWN_QUANTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def false_positives(trades: DataFrame) -> DataFrame:
    """Losing calls of the model; the outcome columns must be there."""
    missing = {"is_true_positive", "min_loss_120m"} - set(trades.columns)
    if missing:
        raise ValueError(f"trades lack {sorted(missing)}")
    return trades.where(~F.col("is_true_positive"))


def risk_report(fp: DataFrame, loss: str = "min_loss_120m") -> DataFrame:
    """One row of drawdown statistics.  Shares are of all rows, NULL losses included.

    p75/p90/p95 of negative numbers are ever milder stops; they are named by
    percentile for that reason.
    """
    x, n = F.col(loss), F.count(F.lit(1))
    share = lambda cond: (count_if(cond) / n)
    head = fp.agg(
        n.alias("total_false_positives"), share(x >= 0).alias("pct_price_never_below_entry"),
        F.avg(x).alias("mean_worst_drawdown_pct"), F.min(x).alias("max_worst_drawdown_pct"),
        share((x >= -5) & (x < 0)).alias("pct_0_to_5pct"),
        share((x >= -10) & (x < -5)).alias("pct_5_to_10pct"),
        share((x >= -15) & (x < -10)).alias("pct_10_to_15pct"),
        share((x >= -20) & (x < -15)).alias("pct_15_to_20pct"),
        share(x < -20).alias("pct_over_20pct"),
        *[share(x < s).alias(f"stop_{int(-s)}pct_triggered_pct") for s in REPORT_STOPS])
    q = exact_quantiles(fp, [], loss, DRAWDOWN_QUANTILES)
    q = q.select(F.col("p50").alias("median_worst_drawdown_pct"),
                 *[F.col(p).alias(f"{p}_worst_drawdown_pct") for p in ("p25", "p50", "p75", "p90")],
                 *[F.col(p).alias(f"stop_loss_{p}_pct") for p in ("p75", "p90", "p95")])
    return join_results(head, q, ())


def stop_loss_impact(fp: DataFrame, levels: Sequence[float] = STOP_LEVELS,
                     loss: str = "min_loss_120m") -> DataFrame:
    """Per stop level: caught share, and the worst loss left uncaught.  One pass for all levels."""
    x, n = F.col(loss), F.count(F.lit(1))
    per_level = F.array(*[F.struct(
        F.lit(float(s)).alias("stop_level_pct"), count_if(x < s).alias("triggered_count"),
        (count_if(x < s) / n).alias("triggered_pct"), count_if(x >= s).alias("uncaught_count"),
        F.coalesce(F.min(F.when(x >= s, x)), F.lit(0.0)).alias("uncaught_max_loss_pct"))
        for s in sorted(levels)])
    return fp.agg(per_level.alias("_l")).select(F.inline("_l"))


def equal_width_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Counts per equal-width bin between minimum and maximum; the last bin is closed."""
    x = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    lo, hi = x.agg(F.min("_x")).scalar(), x.agg(F.max("_x")).scalar()
    width = F.col("_hi") - F.col("_lo")
    place = F.least(F.lit(bins - 1), F.floor(ratio((F.col("_x") - F.col("_lo")) * bins, width)).cast("int"))
    counted = (x.withColumn("_lo", lo).withColumn("_hi", hi)
               .groupBy(F.coalesce(place, F.lit(0)).alias("bin"), "_lo", "_hi")
               .agg(F.count(F.lit(1)).alias("n")))
    every = counted.agg(F.collect_list(F.struct("bin", "n")).alias("_got"), F.max("_lo").alias("_lo"),
                        F.max("_hi").alias("_hi"), F.sum("n").alias("_all"))
    filled = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce(F.try_element_at(F.map_from_entries("_got"), F.col("bin")), F.lit(0))
    return filled.select(
        F.col("bin").cast("long").alias("bin"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins).alias("left_edge"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / bins).alias("right_edge"),
        n.cast("long").alias("n"), (n * 100.0 / F.col("_all")).alias("pct"))


def expected_value(precision: Column, win: Column, loss: Column) -> Column:
    """struct(win_rate, loss_rate, expected_value_pct, profitable, breakeven_win_rate)."""
    ev = precision * win + (1 - precision) * loss
    return F.struct(
        precision.alias("win_rate"), (1 - precision).alias("loss_rate"), ev.alias("expected_value_pct"),
        (ev > 0).alias("profitable"), ratio(-loss, win - loss).alias("breakeven_win_rate"))


def trade_expected_value(trades: DataFrame, stop_loss: float = -10.0, by: Sequence[str] = ()) -> DataFrame:
    """Expected value from realised trades; the stop level stands in for a missing average loss."""
    hit = F.col("is_true_positive")
    stats = trades.groupBy(*by).agg(
        (count_if(hit) / F.count(F.lit(1))).alias("p"),
        F.avg(F.when(hit, F.col("max_gain_120m"))).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(~hit, F.col("min_loss_120m"))), F.lit(stop_loss)).alias("avg_loss_pct"))
    ev = expected_value(F.col("p"), F.col("avg_win_pct"), F.col("avg_loss_pct"))
    return stats.select(*by, "avg_win_pct", "avg_loss_pct", ev.alias("_e")).select(
        *by, "avg_win_pct", "avg_loss_pct", "_e.*")


def importance_table(df: DataFrame, feature: str = "feature", score: str = "importance",
                     top: int | None = None) -> DataFrame:
    """Share of total and rank over a table of one row per feature.

    With ``top`` the strongest features are picked by a limited sort before they are ranked.
    """
    known = df.withColumn(score, F.coalesce(score, F.lit(0.0)))
    order = [F.col(score).desc(), F.col(feature)]
    picked = known.orderBy(*order).limit(top) if top else known
    if top:
        ranked = picked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # ``top`` rows
    else:
        ranked = (global_position(picked.withColumn("_down", -F.col(score)), "_down", [feature], "_at")
                  .withColumn("rank", (F.col("_at") + 1).cast("int")).drop("_down", "_at"))
    total = known.agg(F.sum(score)).scalar()
    return ranked.withColumn("_total", total).withColumn("share", F.coalesce(ratio(F.col(score), F.col("_total")), F.lit(0.0))).drop(
        "_total").orderBy("rank")
