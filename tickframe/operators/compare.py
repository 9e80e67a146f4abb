"""Side-by-side model results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import option_type
from ..functions.numeric import count_if, ratio
from ..session import materialise
from .metrics import KEY_GRID, cuts_reached, threshold_at
from .quantiles import exact_quantiles
from .trades import FEE_USD

# Monthly target and stability bands.
MONTHLY_TARGET_USD = 10_000.0
STABILITY_BANDS = (0.03, 0.06)
MIN_POSITIVES = 10


def model_threshold_results(trades: DataFrame, thresholds: Sequence[float] = KEY_GRID,
                            score: str = "proba", fee_usd: float = FEE_USD) -> DataFrame:
    """P&L per (model, threshold) from the outcomes of every candidate row.

    An outcome does not depend on the threshold, so equal outcomes are counted once per
    (model, thresholds reached, side, type) and written; cells spread over the thresholds
    and medians both come from these counts, whatever the outcomes cost.
    """
    k = len(thresholds)
    t = (trades.withColumn("_c", cuts_reached(F.col(score), thresholds)).where(F.col("_c") > 0)
         .withColumn("_k", option_type(F.col("ticker"), "X")))
    pnl = F.col("profit_loss_usd")
    t = materialise(t.groupBy("model", "_c", "is_winner", "_k", "profit_loss_usd").agg(F.count(F.lit(1)).alias("n")), "outcomes")
    cells = t.groupBy("model", "_c", "is_winner", "_k").agg(
        F.sum("n").alias("n"), F.sum(pnl * F.col("n")).alias("s"), F.min(pnl).alias("lo"), F.max(pnl).alias("hi"))
    spread = (cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
              .withColumn("_on", F.col("_c") > F.col("level")))
    on, win = F.col("_on"), F.col("is_winner")
    total = lambda c, cond: F.coalesce(F.sum(F.when(on & cond, F.col(c))), F.lit(0))
    zero = F.lit(0.0)
    stats = spread.groupBy("model", "level").agg(
        total("n", F.lit(True)).alias("total_signals"),
        total("n", F.col("_k") == "C").alias("calls"), total("n", F.col("_k") == "P").alias("puts"),
        total("n", win).alias("wins"), total("n", ~win).alias("losses"),
        F.coalesce(F.min(F.when(on & win, F.col("lo"))), zero).alias("win_profit_min"),
        F.coalesce(F.max(F.when(on & win, F.col("hi"))), zero).alias("win_profit_max"),
        F.coalesce(F.min(F.when(on & ~win, F.col("lo"))), zero).alias("loss_amount_min"),
        F.coalesce(F.max(F.when(on & ~win, F.col("hi"))), zero).alias("loss_amount_max"),
        total("s", win).cast("double").alias("gross_profit_usd"),
        total("s", ~win).cast("double").alias("gross_loss_usd"))
    n = F.col("total_signals").cast("double")
    out = (
        stats.withColumn("threshold", threshold_at(F.col("level"), thresholds))
        .withColumn("call_pct", F.coalesce(ratio(F.col("calls") * 100.0, n), zero))
        .withColumn("put_pct", F.coalesce(ratio(F.col("puts") * 100.0, n), zero))
        .withColumn("win_rate", F.coalesce(ratio(F.col("wins").cast("double"), n), zero))
        .withColumn("win_profit_mean", F.coalesce(ratio(F.col("gross_profit_usd"), F.col("wins").cast("double")), zero))
        .withColumn("loss_amount_mean", F.coalesce(ratio(F.col("gross_loss_usd"), F.col("losses").cast("double")), zero))
        .withColumn("monthly_profit_usd", F.col("gross_profit_usd") + F.col("gross_loss_usd"))
        .withColumn("total_fees_usd", F.col("total_signals") * F.lit(fee_usd))
        .withColumn("net_profit_usd", F.col("monthly_profit_usd") - F.col("total_fees_usd"))
        .withColumn("avg_pnl_per_trade_usd", F.coalesce(ratio(F.col("monthly_profit_usd"), n), zero)))
    med = exact_quantiles(t, ["model", "is_winner"], "profit_loss_usd", {"m": 0.5}, ("_c", k), weight="n")
    med = med.groupBy("model", "level").agg(
        F.max(F.when(F.col("is_winner"), F.col("m"))).alias("win_profit_median"),
        F.max(F.when(~F.col("is_winner"), F.col("m"))).alias("loss_amount_median"))
    return (out.join(med, ["model", "level"], "left")
            .fillna(0.0, ["win_profit_median", "loss_amount_median"]).drop("level"))


def signal_overlap(trades: DataFrame, threshold: float, score: str = "proba",
                   keys: Sequence[str] = ("ticker", "entry_time")) -> DataFrame:
    """Signals by the models that fire on the same contract and bar.

    One row per set of agreeing models with the totals beside it, a row of zeros
    without any signal; the collected set holds model names, as many as there
    are models.  The number of models counts silent ones too.
    """
    fired = trades.where(F.col(score) >= threshold)
    n_models = trades.agg(F.count_distinct("model")).scalar()
    agree = fired.groupBy(*keys).agg(F.array_sort(F.collect_set("model")).alias("_m"))
    counts = agree.groupBy(F.size("_m").alias("n_agree"), F.array_join("_m", ",").alias("models")).agg(F.count(F.lit(1)).alias("signals"))
    whole = counts.withColumn("n_models", n_models)
    need = F.floor(F.col("n_models") / 2) + 1
    totals = whole.agg(
        F.collect_list(F.struct(F.col("n_agree").cast("long").alias("n_agree"), "models", "signals")).alias("_rows"),
        F.coalesce(F.sum("signals"), F.lit(0)).alias("total_unique_signals"),
        F.coalesce(F.sum(F.when(F.col("n_agree") == F.col("n_models"), F.col("signals"))), F.lit(0)).alias("all_models_agree"),
        F.coalesce(F.sum(F.when(F.col("n_agree") >= need, F.col("signals"))), F.lit(0)).alias("majority_agree"))
    none = F.array(F.struct(F.lit(0).cast("long").alias("n_agree"), F.lit("").alias("models"), F.lit(0).cast("long").alias("signals")))
    return totals.select("total_unique_signals", "all_models_agree", "majority_agree",
                         F.inline(F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(none)))


def comparison_report(results: DataFrame, threshold: float = 0.80,
                      target_usd: float = MONTHLY_TARGET_USD) -> DataFrame:
    """One row per model at a fixed threshold."""
    at = results.where(F.abs(F.col("threshold") - threshold) < 1e-9)
    return at.select("model", "total_signals", "win_rate", "call_pct", "put_pct", "win_profit_mean",
                     "loss_amount_mean", "net_profit_usd", (F.col("net_profit_usd") >= target_usd).alias("meets_target"))


def best_threshold_per_model(results: DataFrame) -> DataFrame:
    """The lowest threshold with the best net profit for each model."""
    best = F.max_by(F.struct("threshold", "net_profit_usd", "total_signals", "win_rate"),
                    F.struct("net_profit_usd", -F.col("threshold")))
    return results.groupBy("model").agg(best.alias("_b")).select(
        "model", F.col("_b.threshold").alias("best_threshold"), "_b.net_profit_usd",
        "_b.total_signals", "_b.win_rate")


def fold_metrics(rows: DataFrame, threshold: float, min_positives: int = MIN_POSITIVES,
                 train_positives: DataFrame | None = None, label: str = "target", score: str = "proba") -> DataFrame:
    """Confusion counts, precision, recall, rate and EV per split index."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    tp, fp, fn, tn = count_if(hit & y), count_if(hit & ~y), count_if(~hit & y), count_if(~hit & ~y)
    zero = F.lit(0.0)
    p = F.coalesce(ratio(tp.cast("double"), (tp + fp).cast("double")), zero)
    r = F.coalesce(ratio(tp.cast("double"), (tp + fn).cast("double")), zero)
    g = F.coalesce(F.avg(F.when(hit & y, F.col("max_gain_120m"))), zero)
    l = F.coalesce(F.avg(F.when(hit & ~y, F.col("min_loss_120m"))), zero)
    out = rows.groupBy("split_index").agg(
        F.count(F.lit(1)).alias("test_samples"), (tp + fp).alias("total_signals"), tp.alias("true_positives"),
        fp.alias("false_positives"), fn.alias("false_negatives"), tn.alias("true_negatives"),
        p.alias("precision"), r.alias("recall"), ((tp + fp) / F.count(F.lit(1))).alias("signal_rate"),
        g.alias("tp_avg_gain_pct"), l.alias("fp_avg_loss_pct"),
        F.when(tp + fp > 0, p * g + (1 - p) * l).otherwise(zero).alias("expected_value_pct"))
    if train_positives is None:
        return out.withColumn("status", F.lit("SUCCESS"))
    joined = train_positives.join(out, "split_index", "left")
    short = (F.coalesce("train_positives", F.lit(0)) < min_positives) | F.col("test_samples").isNull()
    return joined.withColumn("status", F.when(short, "INSUFFICIENT_DATA").otherwise("SUCCESS"))


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    """Spread of the successful splits (a few per year) and a stability band.

    Where the folds have trades, the totals of the months with any follow.
    """
    ok = folds.where(F.col("status") == "SUCCESS")
    sd = F.stddev_pop("precision")
    totals = []
    if "total_trades" in folds.columns:
        n, wins = F.coalesce(F.sum("total_trades"), F.lit(0)), F.coalesce(F.sum("winning_trades"), F.lit(0))
        net = F.round(F.sum(F.when(F.col("total_trades") > 0, F.col("net_profit_after_fees_usd"))), 2)
        totals = [count_if(F.col("total_trades") > 0).alias("months_simulated"), n.alias("total_trades"), wins.alias("total_wins"),
                  (n - wins).alias("total_losses"), ratio(wins.cast("double"), n.cast("double")).alias("overall_win_rate"),
                  net.alias("total_net_profit_usd")]
    return ok.agg(
        *totals,
        F.count(F.lit(1)).alias("successful_splits"),
        F.avg("precision").alias("precision_mean"), F.median("precision").alias("precision_median"),
        sd.alias("precision_std"), F.min("precision").alias("precision_min"), F.max("precision").alias("precision_max"),
        F.avg("total_signals").alias("signals_mean"), F.median("total_signals").alias("signals_median"),
        F.min("total_signals").alias("signals_min"), F.max("total_signals").alias("signals_max"),
        F.avg("expected_value_pct").alias("ev_mean"), F.median("expected_value_pct").alias("ev_median"),
        F.stddev_pop("expected_value_pct").alias("ev_std"),
        F.when(sd < STABILITY_BANDS[0], "good").when(sd < STABILITY_BANDS[1], "moderate")
        .otherwise("poor").alias("stability"))
