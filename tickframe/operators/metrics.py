"""Classification metrics and threshold sweeps on scored rows.

Thresholds are never multiplied with the rows.  Each row is reduced to the
number of thresholds it reaches, cells of that number are aggregated once, and
only the cells (thresholds x periods x classes) are spread over thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_if, join_results, ratio
from ..session import materialise
from .quantiles import exact_quantiles

# Threshold grids.
SWEEP_GRID = tuple(round(0.70 + i / 100, 2) for i in range(26))
KEY_GRID = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
SEARCH_GRID = tuple(round(0.50 + i / 100, 2) for i in range(50))
_AUC_BITS, _AUC_STEP = 60, 15


def apply_threshold(df: DataFrame, threshold: float, score: str = "proba", name: str = "predicted") -> DataFrame:
    return df.withColumn(name, F.when(F.col(score) >= threshold, 1).otherwise(0))


def cuts_reached(score: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds the score reaches."""
    return reduce(lambda a, b: a + b, [F.when(score >= t, 1).otherwise(0) for t in thresholds])


def threshold_at(index: Column, thresholds: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(t)) for t in thresholds]), index)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """All 0.0 on a zero denominator."""
    zero = F.lit(0.0)
    p = F.coalesce(ratio(tp.cast("double"), (tp + fp).cast("double")), zero)
    r = F.coalesce(ratio(tp.cast("double"), (tp + fn).cast("double")), zero)
    f = F.coalesce(ratio(2 * tp.cast("double"), (2 * tp + fp + fn).cast("double")), zero)
    return p, r, f


def score_cell(score: Column) -> Column:
    """The score as a whole number of 2^-60ths; scores outside [0, 1] are refused."""
    return F.when((score >= 0) & (score <= 1), F.floor(score * 2.0 ** _AUC_BITS)).otherwise(
        F.raise_error(F.concat(F.lit("not a score: "), score.cast("string")))).cast("long")


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "target", score: str = "proba") -> DataFrame:
    """Rank AUC with ties at half, NULL when a class is missing.

    Scores in [0, 1] are first counted per distinct value.  Wins of positives over negatives are added up level by
    level: among the scores of a band of 2^-45, then among the 32,768 bands of the next wider one, up to the whole, so
    packed scores are split however close they are.
    """
    pos, neg = count_if(F.col(label) == 1), count_if(F.col(label) == 0)
    counted = (df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_s"))
               .agg(pos.alias("_p"), neg.alias("_q")))
    nodes = counted.withColumn("_u", F.col("_p") * F.col("_q") / 2).withColumn("_cell", score_cell(F.col("_s")))
    order = ["_cell", "_s"]
    for _ in range(_AUC_BITS // _AUC_STEP):
        band = F.shiftright("_cell", _AUC_STEP)
        below = Window.partitionBy(*by, "_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        beaten = F.coalesce(F.sum("_q").over(below), F.lit(0))
        nodes = (nodes.withColumn("_band", band).withColumn("_u", F.col("_u") + F.col("_p") * beaten)
                 .groupBy(*by, F.col("_band").alias("_cell")).agg(*[F.sum(c).alias(c) for c in ("_u", "_p", "_q")]))
        order = ["_cell"]
    # what is left are the lower and the closed upper end of [0, 1]
    top = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    summed = nodes.withColumn("_b", F.coalesce(F.sum("_q").over(top), F.lit(0)))
    pairs = F.sum("_p").cast("double") * F.sum("_q")
    return summed.groupBy(*by).agg(
        ratio(F.sum(F.col("_u") + F.col("_p") * F.col("_b")), pairs).alias("roc_auc"))


def classification_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (),
                           label: str = "target", score: str = "proba") -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    tp, fp = count_if(hit & y), count_if(hit & ~y)
    fn, tn = count_if(~hit & y), count_if(~hit & ~y)
    p, r, f = precision_recall_f1(tp, fp, fn)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), ((tp + tn) / F.count(F.lit(1))).alias("accuracy"),
        p.alias("precision"), r.alias("recall"), f.alias("f1"))
    return join_results(out, roc_auc(df, by, label, score), by)


def backtest_metrics(df: DataFrame, threshold: float, by: Sequence[str] = (), label: str = "target",
                     score: str = "proba", gain: str = "max_gain_120m") -> DataFrame:
    """Signals, hits, rates, precision/recall/F1, AUC, average gains and lift."""
    hit, y, g = F.col(score) >= threshold, F.col(label) == 1, F.col(gain)
    n, tp, fp, fn = F.count(F.lit(1)), count_if(hit & y), count_if(hit & ~y), count_if(~hit & y)
    p, r, f = precision_recall_f1(tp, fp, fn)
    base, sig = F.avg(g), F.avg(F.when(hit, g))
    out = df.groupBy(*by).agg(
        n.alias("n_test_rows"), (tp + fp).alias("n_signals"), tp.alias("n_true_positives"),
        fp.alias("n_false_positives"), ((tp + fp) / n).alias("signal_rate"),
        ((tp + fn) / n).alias("positive_rate_test"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
        base.alias("avg_gain_all_bars"), sig.alias("avg_gain_signals"),
        F.avg(F.when(hit & y, g)).alias("avg_gain_tp"), F.avg(F.when(hit & ~y, g)).alias("avg_gain_fp"),
        F.when(base > 0, sig / base).alias("lift"))
    return join_results(out, roc_auc(df, by, label, score), by)


def _cells(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and sums of the outcome ``_x`` per (group, cuts reached, class); a row stands for ``_w`` equal ones."""
    x, w = F.col("_x"), F.when(F.col("_x").isNotNull(), F.col("_w"))
    return df.groupBy(*by, "_c", "_y").agg(
        F.sum("_w").alias("n"), F.coalesce(F.sum(w), F.lit(0)).alias("x_n"), F.max(x).alias("x_max"), F.min(x).alias("x_min"),
        F.sum(w * x).alias("x_sum"), F.sum(w * x * x).alias("x_square"))


def _merged(prefix: str, keep: Column) -> list[Column]:
    """Moments over the kept cells, merged from their counts and sums."""
    kept = lambda name: F.when(keep, F.col(name))
    total, high, low = F.coalesce(F.sum(kept("x_n")), F.lit(0)), F.max(kept("x_max")), F.min(kept("x_min"))
    m = ratio(F.sum(kept("x_sum")), total.cast("double"))
    square = F.sum(kept("x_square")) - total * m * m
    sd = (F.when((total == 1) | ((total > 1) & (high == low)), F.lit(0.0))
          .when(total > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (total - 1))))
    return [total.alias(f"{prefix}_count"), high.alias(f"{prefix}_max"), m.alias(f"{prefix}_avg"), low.alias(f"{prefix}_min"),
            sd.alias(f"{prefix}_std")]


def with_periods(df: DataFrame, date: str = "date") -> DataFrame:
    """Each row under its whole-table, month and day heading (scope, period)."""
    periods = {"full": F.lit("all"), "month": F.substring(date, 1, 7), "day": F.col(date)}
    return df.select("*", F.inline(F.array(
        *[F.struct(F.lit(s).alias("scope"), p.alias("period")) for s, p in periods.items()])))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = SWEEP_GRID, by: Sequence[str] = (),
                    periods: str | None = None, medians: bool = True, label: str = "target", score: str = "proba",
                    gain: str = "max_gain_120m", loss: str = "min_loss_120m") -> DataFrame:
    """Every metric per group and threshold.

    ``periods`` names a date column: results then come for the whole table, each
    month and each day (columns scope, period), rolled up from daily cells.  With medians equal
    outcomes are counted once and written; cells and medians come from the counts, so rows are read once.
    """
    k = len(thresholds)
    fine = [*by, periods] if periods else list(by)
    keys = [*by, "scope", "period"] if periods else list(by)
    rollup = (lambda d: with_periods(d, periods)) if periods else None
    # gains of positives, losses of negatives
    outcome = F.when(F.col("_y") == 1, F.col("_gain")).otherwise(F.col("_loss"))
    base = df.select(*fine, cuts_reached(F.col(score), thresholds).alias("_c"),
                     F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("_y"),
                     F.col(gain).cast("double").alias("_gain"), F.col(loss).cast("double").alias("_loss"))
    base = base.select(*fine, "_c", "_y", outcome.alias("_x"), F.lit(1).cast("long").alias("_w"))
    if medians:
        base = materialise(base.groupBy(*fine, "_c", "_y", "_x").agg(F.sum("_w").alias("_w")), "outcomes")
    hit, y = F.col("_c") > F.col("level"), F.col("_y") == 1
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    cells = _cells(base, fine)
    cells = (rollup(cells) if rollup else cells).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    swept = cells.groupBy(*keys, "level").agg(
        n(hit & y).alias("true_positives"), n(hit & ~y).alias("false_positives"),
        n(~hit & y).alias("false_negatives"), n(~hit & ~y).alias("true_negatives"),
        *_merged("tp_profit_pct", hit & y), *_merged("fp_loss_pct", hit & ~y), *_merged("fn_missed_pct", ~hit & y))
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    p, r, f = precision_recall_f1(tp, fp, fn)
    zero = F.lit(0.0)
    ev = (F.col("precision") * F.coalesce("tp_profit_pct_avg", zero)
          + (1 - F.col("precision")) * F.coalesce("fp_loss_pct_avg", zero))
    out = swept.withColumns({
        "threshold": threshold_at(F.col("level"), thresholds), "total_signals": tp + fp,
        "signal_rate": (tp + fp) / (tp + fp + fn + tn), "precision": p, "recall": r, "f1_score": f,
    }).withColumn("expected_value_pct", F.when(tp + fp > 0, ev).otherwise(zero))
    if medians:
        # levels 0..k-1 above, k..2k-1 below each threshold
        q = exact_quantiles(base, [*fine, "_y"], "_x", {"m": 0.5}, ("_c", k), True, rollup, [*keys, "_y"], weight="_w")
        above_it = F.col("level") < k
        q = q.groupBy(*keys, F.pmod("level", F.lit(k)).alias("level")).agg(
            F.max(F.when(above_it & y, F.col("m"))).alias("tp_profit_pct_median"),
            F.max(F.when(above_it & ~y, F.col("m"))).alias("fp_loss_pct_median"),
            F.max(F.when(~above_it & y, F.col("m"))).alias("fn_missed_pct_median"))
        out = out.join(q, [*keys, "level"], "left")
    return out.drop("level")


def monthly_pivot(monthly: DataFrame, thresholds: Sequence[float] = KEY_GRID) -> DataFrame:
    """One row per month with signals, precision and EV at the key thresholds (0 when absent)."""
    at = lambda col, t: F.coalesce(F.max(F.when(
        F.abs(F.col("threshold") - t) < 1e-9, F.col(col))), F.lit(0))
    cols = []
    for t in thresholds:
        pct = round(t * 100)
        cols += [at("total_signals", t).alias(f"signals_{pct}"),
                 at("precision", t).alias(f"precision_{pct}"),
                 at("expected_value_pct", t).alias(f"ev_{pct}")]
    return monthly.groupBy(F.col("period").alias("month")).agg(*cols)


def optimal_threshold(sweep: DataFrame, metric: str = "expected_value_pct", min_precision: float = 0.90,
                      min_signals: int = 10) -> DataFrame:
    """The lowest threshold with the best metric under the constraints; NULL and a status if none."""
    ok = (F.col("precision") >= min_precision) & (F.col("total_signals") >= min_signals) & F.col(metric).isNotNull()
    best = F.max_by(F.col("threshold"), F.when(ok, F.struct(F.col(metric), -F.col("threshold"))))
    return sweep.agg(best.alias("optimal_threshold"), F.max(F.when(ok, F.col(metric))).alias("best_value")).select(
        F.when(F.col("optimal_threshold").isNull(), "NO_VALID_THRESHOLD").otherwise("SUCCESS").alias("status"),
        "optimal_threshold", "best_value")


def precision_threshold(df: DataFrame, min_precision: float, thresholds: Sequence[float] = SEARCH_GRID,
                        label: str = "target", score: str = "proba") -> DataFrame:
    """Highest recall among thresholds that keep the precision; the lowest threshold on ties."""
    base = df.select(cuts_reached(F.col(score), thresholds).alias("_c"), F.col(label).alias("_y"))
    cells = base.groupBy("_c", "_y").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))))
    hit, y = F.col("_c") > F.col("level"), F.col("_y") == 1
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    rows = cells.groupBy("level").agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"))
    rows = rows.select(
        threshold_at(F.col("level"), thresholds).alias("threshold"),
        (F.col("tp") + F.col("fp")).alias("n_signals"),
        ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        F.coalesce(ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")),
                   F.lit(0.0)).alias("recall"))
    return (rows.where((F.col("precision") >= min_precision) & (F.col("n_signals") > 0))
            .orderBy(F.col("recall").desc(), "threshold").limit(1))
