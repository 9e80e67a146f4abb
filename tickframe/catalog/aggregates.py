"""Aggregations, reports and monitoring statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import exchange_clock
from ..operators import balance, bars, compare, labels, metrics, monitoring, risk, scanners, splits, trades
from ..operators.quality import validate
from ..plans.consolidate import attach_news
from ..plans.features import prepare_training
from ..sources import views
from .base import Catalog, sql
from .joins import OPTION_SIDE_SQL, TRADES_SQL, index_bars, option_side, underlying_bars
from .predicates import RECORDS_SQL, _rules_sql, records

CATALOG = Catalog()
add = CATALOG.add

_BAR = "trade_date:s ts_ms:l open:d high:d low:d close:d"


@add("A1_resample_ohlcv", f"ticker:s {_BAR} volume:l transactions:l vwap:d", sql("SELECT * FROM bars", "bars"))
def resample_ohlcv(spark, sf):
    return views.bars(spark, sf)


@add("A2_resample_ohlc", _BAR, sql("SELECT * FROM idx", "idx"))
def resample_ohlc(spark, sf):
    return index_bars(spark, sf)


@add("A3_resample_options", f"ticker:s {_BAR} volume:l option_avg_price:d", sql("""
    SELECT ticker, trade_date, ts_ms - ts_ms % 900000 AS ts_ms, arg_min(price, event_id) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, event_id) AS close, sum(volume) AS volume, avg(price) AS option_avg_price
    FROM ticks WHERE ticker IN ('purchase', 'signup') GROUP BY ALL""", "ticks"))
def resample_options(spark, sf):
    return bars.resample_options(views.option_ticks(spark, sf), width_ms=views.BAR_MS, order="event_id")


@add("A4_consolidation_stats", "trade_date:s total_rows:l minutes:l contracts:l has_options:b has_news:b", sql("""
    SELECT trade_date, count(*) AS total_rows, count(DISTINCT ts_ms) AS minutes, count(DISTINCT ticker) AS contracts,
        count(ticker) > 0 AS has_options, count(article_id) > 0 AS has_news
    FROM (SELECT u.trade_date, u.ts_ms, opt.ticker, n.article_id
          FROM und u ASOF LEFT JOIN news n ON u.trade_date = n.trade_date AND u.ts_ms >= n.ts_ms
          LEFT JOIN opt ON u.trade_date = opt.trade_date AND u.ts_ms = opt.ts_ms)
    WHERE ticker IS NOT NULL OR trade_date NOT IN (SELECT trade_date FROM opt) GROUP BY trade_date""",
    "und", "news", "terms", opt=OPTION_SIDE_SQL))
def consolidation_stats(spark, sf):
    from ..operators.flatten import flatten_with_fallback
    u = attach_news(underlying_bars(spark, sf), views.news(spark, sf), grid_ms=views.BAR_MS)
    return bars.consolidation_stats(flatten_with_fallback(u, option_side(spark, sf)))


LABELS_SQL = """SELECT *, CASE WHEN max_gain_120m >= 20 THEN 1 ELSE 0 END AS target FROM (
    SELECT *, CASE WHEN close > 0 THEN (best.p - close) / close * 100 END AS max_gain_120m,
        CASE WHEN close > 0 THEN (worst - close) / close * 100 END AS min_loss_120m,
        CASE WHEN close > 0 AND best IS NOT NULL THEN (-best.t - ts_ms) / 60000.0::DOUBLE END AS time_to_max_min
    FROM (SELECT *, max({'p': close, 't': -ts_ms}) OVER w AS best, min(close) OVER w AS worst FROM bars
          WINDOW w AS (PARTITION BY ticker, trade_date ORDER BY ts_ms RANGE BETWEEN 1 FOLLOWING AND 7200000 FOLLOWING)))"""


def labelled(spark, sf):
    return labels.forward_labels(views.bars(spark, sf))


@add("A6_label_stats",
     "ticker:s total_rows:l positives:l negatives:l positive_rate:d coverage_pct:d max_gain_pct:d mean_gain_pct:d", sql("""
    SELECT ticker, count(*) AS total_rows, sum(target) AS positives, count(*) - sum(target) AS negatives,
        avg(target) AS positive_rate, count(max_gain_120m) * 100.0 / count(*) AS coverage_pct,
        max(max_gain_120m) AS max_gain_pct, avg(max_gain_120m) AS mean_gain_pct FROM l GROUP BY ticker""", "bars", l=LABELS_SQL))
def label_stats(spark, sf):
    return labels.label_stats(labelled(spark, sf), ["ticker"])


@add("A7_feature_run_stats", "dates_processed:l total_rows:l total_contracts:l positive_rate:d", sql("""
    SELECT count(DISTINCT trade_date) AS dates_processed, count(*) AS total_rows,
        count(DISTINCT (trade_date, ticker)) AS total_contracts, avg(target) AS positive_rate FROM l""", "bars", l=LABELS_SQL))
def feature_run_stats(spark, sf):
    return labels.feature_run_stats(labelled(spark, sf))


_COVERED_SQL = """SELECT b.* FROM bars b JOIN bars f ON f.ticker = b.ticker AND f.trade_date = b.trade_date
    AND f.ts_ms > b.ts_ms AND f.ts_ms <= b.ts_ms + 7200000 GROUP BY ALL HAVING count(*) >= 4"""


@add("A8_prep_stats", "trade_date:s rows_in:l rows_out:l rows_filtered:l distinct_options:l", sql("""
    SELECT trade_date, rows_in, coalesce(rows_out, 0) AS rows_out, rows_in - coalesce(rows_out, 0) AS rows_filtered,
        coalesce(d, 0) AS distinct_options
    FROM (SELECT trade_date, count(*) AS rows_in FROM bars GROUP BY 1) LEFT JOIN
        (SELECT trade_date, count(*) AS rows_out, count(DISTINCT ticker) AS d FROM c GROUP BY 1) USING (trade_date)""",
    "bars", c=_COVERED_SQL))
def prep_stats(spark, sf):
    b = views.bars(spark, sf)
    return labels.prep_stats(b, prepare_training(b, 8, views.BAR_MS))


def events_like(spark, sf):
    """Bars that close above their open by a fifth, shaped as forward events."""
    b = views.option_bars(spark, sf).where((F.col("open") > 0) & (F.col("close") >= F.col("open") * 1.2))
    clock = exchange_clock(F.col("ts_ms"))
    return b.select(
        F.col("trade_date").alias("date"), F.col("symbol").alias("ticker"), clock.alias("entry_time_et"),
        clock.alias("trigger_time_et"), F.pmod("volume", F.lit(97)).alias("minutes_to_trigger"),
        F.round((F.col("close") / F.col("open") - 1) * 100, 2).alias("gain_pct"),
        F.pmod("volume", F.lit(61)).alias("above_20pct_duration_min"),
        (F.pmod("volume", F.lit(61)) + F.col("transactions")).alias("above_10pct_duration_min"))


EVENTS_SQL = """SELECT trade_date AS date, symbol AS ticker, hour(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR) AS hour,
    volume % 97 AS minutes_to_trigger, round((close / open - 1) * 100, 2) AS gain_pct,
    volume % 61 AS above_20pct_duration_min, volume % 61 + transactions AS above_10pct_duration_min,
    CASE WHEN symbol LIKE '%C000%' THEN 'C' ELSE 'P' END AS option_type
    FROM optbars WHERE open > 0 AND close >= open * 1.2"""
_SUMMARY = ("contract_days:l total_bars:l total_events:l min_events:l median_events:d max_events:l minutes_above:l "
            "median_duration:d mean_duration:d positive_minute_rate:d")


def _summary_sql(by: str) -> str:
    head, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {head}d.*{" EXCLUDE (option_type)" if by else ""}, coalesce(minutes_above, 0) AS minutes_above, median_duration, mean_duration,
        coalesce(minutes_above * 100.0::DOUBLE / (SELECT count(*) FROM optbars), 0.0) AS positive_minute_rate
    FROM (SELECT {head}count(*) AS contract_days, sum(bars) AS total_bars, sum(events) AS total_events,
        min(events) AS min_events, median(events) AS median_events, max(events) AS max_events
        FROM (SELECT b.trade_date, b.symbol, CASE WHEN b.symbol LIKE '%C000%' THEN 'C' ELSE 'P' END AS option_type,
              count(*) AS bars, (SELECT count(*) FROM ev e WHERE e.date = b.trade_date AND e.ticker = b.symbol) AS events
              FROM optbars b GROUP BY 1, 2) {group}) d
    LEFT JOIN (SELECT {head}sum(above_20pct_duration_min) AS minutes_above, median(above_20pct_duration_min) AS median_duration,
        avg(above_20pct_duration_min) AS mean_duration FROM ev {group}) r {using}"""


def _symbol_bars(spark, sf):
    return views.option_bars(spark, sf).drop("ticker").withColumnRenamed("symbol", "ticker")


@add("A9_scan_summary", _SUMMARY, sql(_summary_sql(""), "optbars", ev=EVENTS_SQL))
def scan_summary(spark, sf):
    return scanners.scan_summary(_symbol_bars(spark, sf), events_like(spark, sf))


@add("A9_trigger_hours", "hour:l events:l", sql("SELECT hour, count(*) AS events FROM ev GROUP BY hour", "optbars", ev=EVENTS_SQL))
def trigger_hours(spark, sf):
    return scanners.trigger_hours(events_like(spark, sf))


@add("A10_scan_summary_by_type", f"option_type:s {_SUMMARY}", sql(_summary_sql("option_type"), "optbars", ev=EVENTS_SQL))
def scan_summary_by_type(spark, sf):
    return scanners.scan_summary(_symbol_bars(spark, sf), events_like(spark, sf), ["option_type"])


@add("A11_scan_observations",
     "rate_finding:s peak_finding:s peak_hour:l peak_events:l peak_pct:d morning_finding:s morning_peak:l skew_finding:s",
     sql(f"""SELECT CASE WHEN positive_minute_rate >= 50 THEN 'mostly_above' WHEN positive_minute_rate >= 20 THEN 'often_above'
            ELSE 'rarely_above' END AS rate_finding,
        CASE WHEN peak_hour >= 15 THEN 'late_day' WHEN peak_hour <= 9 THEN 'open' ELSE 'mid_session' END AS peak_finding,
        peak_hour, peak_events, peak_events * 100.0 / total_events AS peak_pct,
        CASE WHEN morning_hours >= 2 THEN CASE WHEN mx - mn <= mx * 0.25 THEN 'even' ELSE 'peaked' END END AS morning_finding,
        morning_peak, CASE WHEN mean_duration > 2 * median_duration THEN 'heavy_skew'
            WHEN mean_duration > 1.5 * median_duration THEN 'moderate_skew' ELSE 'symmetric' END AS skew_finding
        FROM ({_summary_sql("")}), (SELECT arg_max(hour, {{'n': n, 'h': -hour}}) AS peak_hour, max(n) AS peak_events,
            count(*) FILTER (hour IN (9, 10, 11)) AS morning_hours, max(n) FILTER (hour IN (9, 10, 11)) AS mx,
            min(n) FILTER (hour IN (9, 10, 11)) AS mn,
            arg_max(hour, {{'n': n, 'h': -hour}}) FILTER (hour IN (9, 10, 11)) AS morning_peak
            FROM (SELECT hour, count(*) AS n FROM ev GROUP BY hour))""", "optbars", ev=EVENTS_SQL))
def scan_observations(spark, sf):
    ev = events_like(spark, sf)
    return scanners.scan_observations(scanners.scan_summary(_symbol_bars(spark, sf), ev), scanners.trigger_hours(ev))


@add("A12_class_weights", "label:s value:l count:l weight:d", """
    SELECT 'quality' AS label, quality AS value, count(*) AS count, (SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)) AS weight
    FROM labels GROUP BY quality UNION ALL SELECT 'toxic', toxic, count(*), (SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*))
    FROM labels GROUP BY toxic""")
def class_weights(spark, sf):
    l = views.table(spark, sf, "labels")
    parts = [balance.class_weights(l, c).withColumnRenamed(c, "value").withColumn("label", F.lit(c))
             for c in ("quality", "toxic")]
    return parts[0].unionByName(parts[1])


@add("A13_imbalance_summary", "ticker:s total:l positives:l negatives:l positive_rate:d imbalance_ratio:d", sql("""
    SELECT ticker, count(*) AS total, sum(target) AS positives, count(*) - sum(target) AS negatives,
        avg(target) AS positive_rate, (count(*) - sum(target)) / CAST(sum(target) AS DOUBLE) AS imbalance_ratio
    FROM l GROUP BY ticker""", "bars", l=LABELS_SQL))
def imbalance_summary(spark, sf):
    return balance.imbalance_summary(labelled(spark, sf), by=["ticker"])


SPLIT_SQL = """SELECT date, CASE WHEN i <= t THEN 'train' WHEN i <= v THEN 'val' ELSE 'test' END AS split FROM (
    SELECT *, least(greatest(CAST(floor(n * 0.70::DOUBLE) AS BIGINT), 1), v - 1) AS t FROM (
    SELECT *, least(greatest(CAST(floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) AS BIGINT),
        greatest(CAST(floor(n * 0.70::DOUBLE) AS BIGINT), 1) + 1), n - 1) AS v FROM (
    SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM scored))))"""


@add("A14_split_summary", "split:s n_rows:l start_date:s end_date:s n_dates:l min_ts:l max_ts:l positive_rate:d", sql("""
    SELECT split, count(*) AS n_rows, min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS n_dates,
        min(timestamp) AS min_ts, max(timestamp) AS max_ts, avg(target) AS positive_rate
    FROM scored JOIN sp USING (date) GROUP BY split""", "scored", sp=SPLIT_SQL))
def split_summary(spark, sf):
    return splits.split_summary(splits.chronological_split(views.scored(spark, sf)))


def auc_sql(src: str, by: str) -> str:
    part, key = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}(sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0::DOUBLE)
        / nullif(CAST(sum(target) AS DOUBLE) * (count(*) - sum(target)), 0) AS roc_auc FROM (
        SELECT *, rank() OVER ({part}ORDER BY proba) + (count(*) OVER (PARTITION BY {key}proba) - 1) / 2.0::DOUBLE AS rk
        FROM {src}) {group}"""


@add("A15_backtest_metrics",
     "model:s n_test_rows:l n_signals:l n_true_positives:l n_false_positives:l signal_rate:d positive_rate_test:d "
     "precision:d recall:d f1:d roc_auc:d avg_gain_all_bars:d avg_gain_signals:d avg_gain_tp:d avg_gain_fp:d lift:d",
     sql(f"""SELECT *, n_signals / CAST(n_test_rows AS DOUBLE) AS signal_rate, p / CAST(n_test_rows AS DOUBLE) AS positive_rate_test,
        n_true_positives / CAST(n_signals AS DOUBLE) AS precision, n_true_positives / CAST(p AS DOUBLE) AS recall,
        2 * n_true_positives / CAST(n_signals + p AS DOUBLE) AS f1, avg_gain_signals / avg_gain_all_bars AS lift
        FROM (SELECT model, count(*) AS n_test_rows, count(*) FILTER (proba >= 0.7) AS n_signals, sum(target) AS p,
            count(*) FILTER (proba >= 0.7 AND target = 1) AS n_true_positives,
            count(*) FILTER (proba >= 0.7 AND target = 0) AS n_false_positives, avg(max_gain_120m) AS avg_gain_all_bars,
            avg(max_gain_120m) FILTER (proba >= 0.7) AS avg_gain_signals,
            avg(max_gain_120m) FILTER (proba >= 0.7 AND target = 1) AS avg_gain_tp,
            avg(max_gain_120m) FILTER (proba >= 0.7 AND target = 0) AS avg_gain_fp FROM scored_models GROUP BY model)
        JOIN ({auc_sql("scored_models", "model")}) USING (model)""", "scored_models"))
def backtest_metrics(spark, sf):
    return metrics.backtest_metrics(views.scored_models(spark, sf), 0.7, ["model"])


@add("A16_classification_metrics", "n_rows:l accuracy:d precision:d recall:d f1:d roc_auc:d", sql(f"""
    SELECT *, (tp + tn) / CAST(n_rows AS DOUBLE) AS accuracy, tp / CAST(tp + fp AS DOUBLE) AS precision,
        tp / CAST(tp + fn AS DOUBLE) AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1,
        (SELECT roc_auc FROM ({auc_sql("scored", "")})) AS roc_auc
    FROM (SELECT count(*) AS n_rows, count(*) FILTER (proba >= 0.6 AND target = 1) AS tp,
        count(*) FILTER (proba >= 0.6 AND target = 0) AS fp, count(*) FILTER (proba < 0.6 AND target = 1) AS fn,
        count(*) FILTER (proba < 0.6 AND target = 0) AS tn FROM scored)""", "scored"))
def classification_metrics(spark, sf):
    return metrics.classification_metrics(views.scored(spark, sf), 0.6)


SWEEP_COLUMNS = ("threshold:d total_signals:l true_positives:l false_positives:l false_negatives:l true_negatives:l "
                 "signal_rate:d precision:d recall:d f1_score:d expected_value_pct:d "
                 + " ".join(f"{p}_count:l {p}_max:d {p}_avg:d {p}_median:d {p}_min:d {p}_std:d"
                            for p in ("tp_profit_pct", "fp_loss_pct", "fn_missed_pct")))


def _stat_sql(prefix: str, col: str, cond: str) -> str:
    f = f"FILTER ({cond} AND {col} IS NOT NULL)"
    return f"""count({col}) {f} AS {prefix}_count, max({col}) {f} AS {prefix}_max, avg({col}) {f} AS {prefix}_avg,
        median({col}) {f} AS {prefix}_median, min({col}) {f} AS {prefix}_min,
        CASE count({col}) {f} WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE stddev_samp({col}) {f} END AS {prefix}_std"""


SWEEP_SQL = f"""SELECT *, tp + fp AS total_signals, tp AS true_positives, fp AS false_positives, fn AS false_negatives,
    tn AS true_negatives, (tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE) AS signal_rate,
    coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
    coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1_score,
    CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) * coalesce(tp_profit_pct_avg, 0)
        + (1 - tp / CAST(tp + fp AS DOUBLE)) * coalesce(fp_loss_pct_avg, 0) ELSE 0.0 END AS expected_value_pct
    FROM (SELECT thr AS threshold, CASE grouping(m, date) WHEN 3 THEN 'full' WHEN 1 THEN 'month' ELSE 'day' END AS scope,
        CASE grouping(m, date) WHEN 3 THEN 'all' WHEN 1 THEN m ELSE date END AS period,
        count(*) FILTER (proba >= thr AND target = 1) AS tp, count(*) FILTER (proba >= thr AND target = 0) AS fp,
        count(*) FILTER (proba < thr AND target = 1) AS fn, count(*) FILTER (proba < thr AND target = 0) AS tn,
        {_stat_sql("tp_profit_pct", "max_gain_120m", "proba >= thr AND target = 1")},
        {_stat_sql("fp_loss_pct", "min_loss_120m", "proba >= thr AND target = 0")},
        {_stat_sql("fn_missed_pct", "max_gain_120m", "proba < thr AND target = 1")}
        FROM (SELECT *, date[:7] AS m FROM scored), thresholds GROUP BY GROUPING SETS ((thr), (thr, m), (thr, date)))"""
GRID_SQL = "SELECT round(0.70 + i / 100.0, 2)::DOUBLE AS thr FROM range(26) t(i)"


def _sweep(spark, sf):
    return metrics.threshold_sweep(views.scored(spark, sf), periods="date")


@add("A17_threshold_sweep", f"scope:s period:s {SWEEP_COLUMNS}", sql(SWEEP_SQL, "scored", thresholds=GRID_SQL))
def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


_PCTS = (70, 75, 80, 85, 90, 95)


@add("A18_monthly_pivot", "month:s " + " ".join(f"signals_{p}:l precision_{p}:d ev_{p}:d" for p in _PCTS), sql(
    "SELECT period AS month, " + ", ".join(
        f"coalesce(max(total_signals) FILTER (threshold = {p / 100}), 0) AS signals_{p}, "
        f"coalesce(max(precision) FILTER (threshold = {p / 100}), 0) AS precision_{p}, "
        f"coalesce(max(expected_value_pct) FILTER (threshold = {p / 100}), 0) AS ev_{p}" for p in _PCTS)
    + f" FROM ({SWEEP_SQL}) WHERE scope = 'month' GROUP BY period", "scored", thresholds=GRID_SQL))
def monthly_pivot(spark, sf):
    s = views.scored(spark, sf).withColumn("period", F.substring("date", 1, 7))
    return metrics.monthly_pivot(metrics.threshold_sweep(s, by=["period"], medians=False))


@add("A19_optimal_threshold", "status:s optimal_threshold:d best_value:d", sql(f"""
    SELECT 'SUCCESS' AS status, threshold AS optimal_threshold, expected_value_pct AS best_value FROM ({SWEEP_SQL})
    WHERE scope = 'full' AND precision >= 0.3 AND total_signals >= 10 ORDER BY expected_value_pct DESC, threshold LIMIT 1""",
    "scored", thresholds=GRID_SQL))
def optimal_threshold(spark, sf):
    sweep = metrics.threshold_sweep(views.scored(spark, sf), medians=False)
    return metrics.optimal_threshold(sweep, "expected_value_pct", 0.3)


@add("A20_precision_threshold", "threshold:d n_signals:l precision:d recall:d", sql("""
    SELECT thr AS threshold, count(*) FILTER (proba >= thr) AS n_signals,
        count(*) FILTER (proba >= thr AND target = 1) / CAST(nullif(count(*) FILTER (proba >= thr), 0) AS DOUBLE) AS precision,
        count(*) FILTER (proba >= thr AND target = 1) / CAST(sum(target) AS DOUBLE) AS recall
    FROM scored JOIN sp USING (date), (SELECT round(0.50 + i / 100.0, 2)::DOUBLE AS thr FROM range(50) t(i))
    WHERE split = 'val' GROUP BY thr HAVING precision >= 0.33 AND n_signals > 0 ORDER BY recall DESC, threshold LIMIT 1""",
    "scored", sp=SPLIT_SQL))
def precision_threshold(spark, sf):
    from ..plans.reports import find_threshold
    return find_threshold(views.scored(spark, sf), 0.33)


_FP_SQL = "SELECT min_loss_120m AS x FROM scored WHERE proba >= 0.5 AND target = 0"


def false_positive_rows(spark, sf):
    return risk.false_positives(trades.build_trades(views.scored(spark, sf), 0.5))


@add("A21_fp_risk_report",
     "total_false_positives:l pct_price_never_below_entry:d mean_worst_drawdown_pct:d median_worst_drawdown_pct:d "
     "max_worst_drawdown_pct:d p25_worst_drawdown_pct:d p50_worst_drawdown_pct:d p75_worst_drawdown_pct:d "
     "p90_worst_drawdown_pct:d pct_0_to_5pct:d pct_5_to_10pct:d pct_10_to_15pct:d pct_15_to_20pct:d pct_over_20pct:d "
     "stop_5pct_triggered_pct:d stop_10pct_triggered_pct:d stop_15pct_triggered_pct:d stop_20pct_triggered_pct:d "
     "stop_loss_p75_pct:d stop_loss_p90_pct:d stop_loss_p95_pct:d", sql("""
    SELECT count(*) AS total_false_positives, count(*) FILTER (x >= 0) / CAST(count(*) AS DOUBLE) AS pct_price_never_below_entry,
        avg(x) AS mean_worst_drawdown_pct, median(x) AS median_worst_drawdown_pct, min(x) AS max_worst_drawdown_pct,
        quantile_cont(x, 0.25) AS p25_worst_drawdown_pct, quantile_cont(x, 0.5) AS p50_worst_drawdown_pct,
        quantile_cont(x, 0.75) AS p75_worst_drawdown_pct, quantile_cont(x, 0.9) AS p90_worst_drawdown_pct,
        count(*) FILTER (x >= -5 AND x < 0) / CAST(count(*) AS DOUBLE) AS pct_0_to_5pct,
        count(*) FILTER (x >= -10 AND x < -5) / CAST(count(*) AS DOUBLE) AS pct_5_to_10pct,
        count(*) FILTER (x >= -15 AND x < -10) / CAST(count(*) AS DOUBLE) AS pct_10_to_15pct,
        count(*) FILTER (x >= -20 AND x < -15) / CAST(count(*) AS DOUBLE) AS pct_15_to_20pct,
        count(*) FILTER (x < -20) / CAST(count(*) AS DOUBLE) AS pct_over_20pct,
        count(*) FILTER (x < -5) / CAST(count(*) AS DOUBLE) AS stop_5pct_triggered_pct,
        count(*) FILTER (x < -10) / CAST(count(*) AS DOUBLE) AS stop_10pct_triggered_pct,
        count(*) FILTER (x < -15) / CAST(count(*) AS DOUBLE) AS stop_15pct_triggered_pct,
        count(*) FILTER (x < -20) / CAST(count(*) AS DOUBLE) AS stop_20pct_triggered_pct,
        quantile_cont(x, 0.75) AS stop_loss_p75_pct, quantile_cont(x, 0.9) AS stop_loss_p90_pct,
        quantile_cont(x, 0.95) AS stop_loss_p95_pct FROM fp""", "scored", fp=_FP_SQL))
def fp_risk_report(spark, sf):
    return risk.risk_report(false_positive_rows(spark, sf))


@add("A22_stop_loss_impact", "stop_level_pct:d triggered_count:l triggered_pct:d uncaught_count:l uncaught_max_loss_pct:d", sql("""
    SELECT s AS stop_level_pct, count(*) FILTER (x < s) AS triggered_count,
        count(*) FILTER (x < s) / CAST(count(*) AS DOUBLE) AS triggered_pct, count(*) FILTER (x >= s) AS uncaught_count,
        coalesce(min(x) FILTER (x >= s), 0.0) AS uncaught_max_loss_pct
    FROM fp, (SELECT unnest([-5.0, -10.0, -15.0, -20.0, -25.0]::DOUBLE[]) AS s) GROUP BY s""", "scored", fp=_FP_SQL))
def stop_loss_impact(spark, sf):
    return risk.stop_loss_impact(false_positive_rows(spark, sf))


@add("A23_equal_width_histogram", "bin:l left_edge:d right_edge:d n:l pct:d", sql("""
    SELECT bin, lo + (hi - lo) * bin / 10 AS left_edge, lo + (hi - lo) * (bin + 1) / 10 AS right_edge,
        count(x) AS n, count(x) * 100.0::DOUBLE / (SELECT count(close) FROM scored) AS pct
    FROM (SELECT unnest(range(10)) AS bin), (SELECT min(close) AS lo, max(close) AS hi FROM scored)
    LEFT JOIN (SELECT close AS x, least(9, CAST(floor((close - l) * 10 / (h - l)) AS BIGINT)) AS b
        FROM scored, (SELECT min(close) AS l, max(close) AS h FROM scored)) ON b = bin GROUP BY ALL""", "scored"))
def equal_width_histogram(spark, sf):
    return risk.equal_width_histogram(views.scored(spark, sf), "close")


@add("A24_expected_value",
     "win_rate:d loss_rate:d avg_win_pct:d avg_loss_pct:d expected_value_pct:d profitable:b breakeven_win_rate:d", sql("""
    SELECT p AS win_rate, 1 - p AS loss_rate, w AS avg_win_pct, l AS avg_loss_pct, p * w + (1 - p) * l AS expected_value_pct,
        p * w + (1 - p) * l > 0 AS profitable, -l / (w - l) AS breakeven_win_rate
    FROM (SELECT avg(target) AS p, avg(max_gain_120m) FILTER (target = 1) AS w,
        avg(min_loss_120m) FILTER (target = 0) AS l FROM scored WHERE proba >= 0.5)""", "scored"))
def expected_value(spark, sf):
    return risk.trade_expected_value(trades.build_trades(views.scored(spark, sf), 0.5))


MONTHLY_COLUMNS = (
    "month:s total_trades:l winning_trades:l losing_trades:l win_rate:d gross_profit_usd:d2 gross_loss_usd:d2 "
    "net_profit_usd:d2 total_fees_usd:d2 net_profit_after_fees_usd:d2 avg_profit_per_win_usd:d4 best_trade_usd:d4 "
    "avg_loss_per_loss_usd:d4 worst_trade_usd:d4 median_profit_per_win_usd:d4 median_loss_per_loss_usd:d4 "
    "avg_return_per_trade_pct:d roi_pct:d avg_time_minutes:d median_time_minutes:d min_time_minutes:d max_time_minutes:d "
    "total_capital_deployed_usd:d2 total_contracts_traded:l calls_traded:l puts_traded:l target_hits:l stops:l")
MONTHLY_SQL = """SELECT date[:7] AS month, count(*) AS total_trades, count(*) FILTER (is_winner) AS winning_trades,
    count(*) FILTER (NOT is_winner) AS losing_trades, avg(CAST(is_winner AS INTEGER)) AS win_rate,
    coalesce(sum(profit_loss_usd) FILTER (is_winner), 0) AS gross_profit_usd,
    coalesce(sum(profit_loss_usd) FILTER (NOT is_winner), 0) AS gross_loss_usd, sum(profit_loss_usd) AS net_profit_usd,
    count(*) * 4.0 AS total_fees_usd, sum(profit_loss_usd) - count(*) * 4.0 AS net_profit_after_fees_usd,
    coalesce(avg(profit_loss_usd) FILTER (is_winner), 0) AS avg_profit_per_win_usd,
    coalesce(max(profit_loss_usd) FILTER (is_winner), 0) AS best_trade_usd,
    coalesce(avg(profit_loss_usd) FILTER (NOT is_winner), 0) AS avg_loss_per_loss_usd,
    coalesce(min(profit_loss_usd) FILTER (NOT is_winner), 0) AS worst_trade_usd,
    coalesce(median(profit_loss_usd) FILTER (is_winner), 0) AS median_profit_per_win_usd,
    coalesce(median(profit_loss_usd) FILTER (NOT is_winner), 0) AS median_loss_per_loss_usd,
    avg(profit_loss_pct) AS avg_return_per_trade_pct,
    (sum(profit_loss_usd) - count(*) * 4.0) / sum(actual_position_size) * 100 AS roi_pct,
    avg(time_in_trade_minutes) AS avg_time_minutes, median(time_in_trade_minutes) AS median_time_minutes,
    min(time_in_trade_minutes) AS min_time_minutes, max(time_in_trade_minutes) AS max_time_minutes,
    sum(actual_position_size) AS total_capital_deployed_usd, sum(num_contracts) AS total_contracts_traded,
    count(*) FILTER (l_partkey % 2 = 0) AS calls_traded, count(*) FILTER (l_partkey % 2 = 1) AS puts_traded,
    count(*) FILTER (exit_reason = 'Target hit') AS target_hits, count(*) FILTER (exit_reason LIKE 'Stop%') AS stops
    FROM trades WHERE proba >= 0.7 GROUP BY 1"""


def month_report(spark, sf):
    t = trades.trade_outcomes(trades.signals_at(views.scored(spark, sf), 0.7))
    r = trades.monthly_trade_report(t)
    count = lambda k: F.coalesce(F.try_element_at("exit_reasons", F.lit(k)), F.lit(0))
    return (r.withColumn("target_hits", count(trades.EXIT_REASONS[1]))
            .withColumn("stops", count(trades.EXIT_REASONS[0]) + count(trades.EXIT_REASONS[2])))


@add("A25_monthly_trade_report", MONTHLY_COLUMNS, sql(MONTHLY_SQL, "scored", trades=TRADES_SQL.format(src="scored")))
def monthly_trade_report(spark, sf):
    return month_report(spark, sf)


@add("A26_target_assessment", "month:s net:d2 assessment:s", sql(f"""
    SELECT month, net_profit_after_fees_usd AS net, CASE WHEN net_profit_after_fees_usd >= 25000 THEN 'EXCEEDS'
        WHEN net_profit_after_fees_usd >= 20000 THEN 'MEETS' WHEN net_profit_after_fees_usd >= 15000 THEN 'BELOW'
        ELSE 'INSUFFICIENT' END AS assessment FROM ({MONTHLY_SQL})""", "scored", trades=TRADES_SQL.format(src="scored")))
def target_assessment(spark, sf):
    net = F.col("net_profit_after_fees_usd")
    return month_report(spark, sf).select("month", net.alias("net"), trades.target_assessment(net).alias("assessment"))


RESULT_COLUMNS = ("model:s threshold:d total_signals:l calls:l puts:l call_pct:d put_pct:d wins:l win_rate:d win_profit_min:d "
                  "win_profit_median:d4 win_profit_mean:d4 win_profit_max:d4 losses:l loss_amount_min:d4 loss_amount_median:d4 "
                  "loss_amount_mean:d4 loss_amount_max:d4 gross_profit_usd:d2 gross_loss_usd:d2 monthly_profit_usd:d2 "
                  "total_fees_usd:d2 net_profit_usd:d2 avg_pnl_per_trade_usd:d4")
RESULTS_SQL = """SELECT model, thr AS threshold, count(*) AS total_signals, count(*) FILTER (l_partkey % 2 = 0) AS calls,
    count(*) FILTER (l_partkey % 2 = 1) AS puts, count(*) FILTER (l_partkey % 2 = 0) * 100.0::DOUBLE / count(*) AS call_pct,
    count(*) FILTER (l_partkey % 2 = 1) * 100.0::DOUBLE / count(*) AS put_pct, count(*) FILTER (is_winner) AS wins,
    count(*) FILTER (is_winner) / CAST(count(*) AS DOUBLE) AS win_rate, count(*) FILTER (NOT is_winner) AS losses,
    min(profit_loss_usd) FILTER (is_winner) AS win_profit_min, median(profit_loss_usd) FILTER (is_winner) AS win_profit_median,
    avg(profit_loss_usd) FILTER (is_winner) AS win_profit_mean, max(profit_loss_usd) FILTER (is_winner) AS win_profit_max,
    min(profit_loss_usd) FILTER (NOT is_winner) AS loss_amount_min, median(profit_loss_usd) FILTER (NOT is_winner) AS loss_amount_median,
    avg(profit_loss_usd) FILTER (NOT is_winner) AS loss_amount_mean, max(profit_loss_usd) FILTER (NOT is_winner) AS loss_amount_max,
    sum(profit_loss_usd) FILTER (is_winner) AS gross_profit_usd, sum(profit_loss_usd) FILTER (NOT is_winner) AS gross_loss_usd,
    sum(profit_loss_usd) AS monthly_profit_usd, count(*) * 4.0 AS total_fees_usd,
    sum(profit_loss_usd) - count(*) * 4.0 AS net_profit_usd, avg(profit_loss_usd) AS avg_pnl_per_trade_usd
    FROM trades, (SELECT unnest([0.70, 0.75, 0.80, 0.85, 0.90, 0.95]::DOUBLE[]) AS thr) WHERE proba >= thr GROUP BY model, thr"""
_MODEL_TRADES = {"trades": TRADES_SQL.format(src="scored_models")}


def model_results(spark, sf):
    return compare.model_threshold_results(trades.trade_outcomes(views.scored_models(spark, sf)))


@add("A27_model_threshold_results", RESULT_COLUMNS, sql(RESULTS_SQL, "scored_models", **_MODEL_TRADES))
def model_threshold_results(spark, sf):
    return model_results(spark, sf)


@add("A28_comparison_report",
     "model:s total_signals:l win_rate:d call_pct:d put_pct:d win_profit_mean:d4 loss_amount_mean:d4 net_profit_usd:d2 meets_target:b",
     sql(f"SELECT *, net_profit_usd >= 10000 AS meets_target FROM ({RESULTS_SQL}) WHERE threshold = 0.8", "scored_models", **_MODEL_TRADES))
def comparison_report(spark, sf):
    return compare.comparison_report(model_results(spark, sf))


@add("A28_best_threshold_per_model", "model:s best_threshold:d net_profit_usd:d2 total_signals:l win_rate:d", sql(f"""
    SELECT *, threshold AS best_threshold FROM ({RESULTS_SQL})
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY net_profit_usd DESC, threshold) = 1""", "scored_models", **_MODEL_TRADES))
def best_threshold(spark, sf):
    return compare.best_threshold_per_model(model_results(spark, sf))


WALK_SQL = """SELECT row_number() OVER (ORDER BY s) AS split_index, strftime(s, '%Y-%m-%d') AS train_start,
    strftime(s + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS train_end, strftime(s + INTERVAL 3 MONTH, '%Y-%m-%d') AS test_start,
    strftime(s + INTERVAL 4 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS test_end
    FROM (SELECT unnest(generate_series(date_trunc('month', CAST(min(date) AS DATE))::TIMESTAMP,
        date_trunc('month', CAST(max(date) AS DATE))::TIMESTAMP, INTERVAL 1 MONTH)) AS s, max(date) AS d1 FROM scored)
    WHERE s + INTERVAL 4 MONTH - INTERVAL 1 DAY <= CAST(d1 AS TIMESTAMP)"""
FOLDS_SQL = """SELECT split_index, train_positives, test_samples, tp + fp AS total_signals, tp AS true_positives, fp AS false_positives,
    fn AS false_negatives, tn AS true_negatives, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
    coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall, (tp + fp) / CAST(test_samples AS DOUBLE) AS signal_rate, g AS tp_avg_gain_pct,
    l AS fp_avg_loss_pct, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) * g + (1 - tp / CAST(tp + fp AS DOUBLE)) * l ELSE 0.0 END
        AS expected_value_pct, CASE WHEN train_positives < 10 THEN 'INSUFFICIENT_DATA' ELSE 'SUCCESS' END AS status
    FROM (SELECT split_index, count(*) AS test_samples, count(*) FILTER (proba >= 0.67 AND target = 1) AS tp,
        count(*) FILTER (proba >= 0.67 AND target = 0) AS fp, count(*) FILTER (proba < 0.67 AND target = 1) AS fn,
        count(*) FILTER (proba < 0.67 AND target = 0) AS tn,
        coalesce(avg(max_gain_120m) FILTER (proba >= 0.67 AND target = 1), 0.0) AS g,
        coalesce(avg(min_loss_120m) FILTER (proba >= 0.67 AND target = 0), 0.0) AS l
        FROM scored JOIN walk ON date BETWEEN test_start AND test_end GROUP BY split_index)
    JOIN (SELECT split_index, sum(target) AS train_positives FROM scored JOIN walk ON date BETWEEN train_start AND train_end
        GROUP BY split_index) USING (split_index)"""


def folds(spark, sf):
    s = views.scored(spark, sf)
    w = splits.walk_forward_splits(s)
    positives = splits.rows_in_splits(s, w, "train").groupBy("split_index").agg(F.sum("target").alias("train_positives"))
    return compare.fold_metrics(splits.rows_in_splits(s, w), 0.67, train_positives=positives)


TOTALS_SQL = """SELECT split_index, count(*) AS total_trades, count(*) FILTER (is_winner) AS winning_trades,
    sum(profit_loss_usd) - count(*) * 4.0 AS net_profit_after_fees_usd FROM {trades} GROUP BY split_index"""


def folds_with_trades(spark, sf):
    s = views.scored(spark, sf)
    test = splits.rows_in_splits(s, splits.walk_forward_splits(s))
    totals = trades.trade_totals(trades.trade_outcomes(trades.signals_at(test, 0.67)), ["split_index"])
    return folds(spark, sf).join(totals, "split_index", "left")


@add("A29_walk_forward_summary",
     "successful_splits:l precision_mean:d precision_median:d precision_std:d precision_min:d precision_max:d signals_mean:d "
     "signals_median:d signals_min:l signals_max:l ev_mean:d ev_median:d ev_std:d stability:s months_simulated:l total_trades:l "
     "total_wins:l total_losses:l overall_win_rate:d total_net_profit_usd:d2", sql(f"""
    SELECT count(total_trades) AS months_simulated, sum(total_trades) AS total_trades, sum(winning_trades) AS total_wins,
        sum(total_trades - winning_trades) AS total_losses, sum(winning_trades) / CAST(sum(total_trades) AS DOUBLE) AS overall_win_rate,
        round(sum(net_profit_after_fees_usd), 2) AS total_net_profit_usd, count(*) AS successful_splits, avg(precision) AS precision_mean, median(precision) AS precision_median,
        stddev_pop(precision) AS precision_std, min(precision) AS precision_min, max(precision) AS precision_max,
        avg(total_signals) AS signals_mean, median(total_signals) AS signals_median, min(total_signals) AS signals_min,
        max(total_signals) AS signals_max, avg(expected_value_pct) AS ev_mean, median(expected_value_pct) AS ev_median,
        stddev_pop(expected_value_pct) AS ev_std, CASE WHEN stddev_pop(precision) < 0.03 THEN 'good'
            WHEN stddev_pop(precision) < 0.06 THEN 'moderate' ELSE 'poor' END AS stability
    FROM ({FOLDS_SQL}) LEFT JOIN ({TOTALS_SQL.format(trades="trades JOIN walk ON date BETWEEN test_start AND test_end")}) USING (split_index)
    WHERE status = 'SUCCESS'""", "scored", walk=WALK_SQL, trades=f"SELECT * FROM ({TRADES_SQL.format(src='scored')}) WHERE proba >= 0.67"))
def walk_forward_summary(spark, sf):
    return compare.walk_forward_summary(folds_with_trades(spark, sf))


@add("A30_fold_metrics",
     "split_index:l train_positives:l test_samples:l total_signals:l true_positives:l false_positives:l false_negatives:l "
     "true_negatives:l precision:d recall:d signal_rate:d tp_avg_gain_pct:d fp_avg_loss_pct:d expected_value_pct:d status:s",
     sql(FOLDS_SQL, "scored", walk=WALK_SQL))
def fold_metrics(spark, sf):
    return folds(spark, sf)


@add("A31_importance_table", "feature:s importance:d share:d rank:l", """
    SELECT feature, importance, importance / sum(importance) OVER () AS share,
        row_number() OVER (ORDER BY importance DESC, feature) AS rank
    FROM (SELECT p_name AS feature, sum(p_retailprice) AS importance FROM part GROUP BY p_name)""")
def importance_table(spark, sf):
    p = views.table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return risk.importance_table(p)


def operations(spark, sf):
    t = views.ticks(spark, sf)
    return t.select(F.col("ticker").alias("operation"), F.col("ts_ms").alias("ended_ms"), F.col("price").alias("seconds"),
                    F.col("volume").alias("records"), "event_id")


@add("A32_latency_stats", "operation:s samples:l p50:d p95:d p99:d throughput:d", sql("""
    SELECT operation, count(*) AS samples, list_sort(list(price))[greatest(0, CAST(floor(count(*) * 50 / 100) AS BIGINT) - 1) + 1] AS p50,
        list_sort(list(price))[greatest(0, CAST(floor(count(*) * 95 / 100) AS BIGINT) - 1) + 1] AS p95,
        list_sort(list(price))[greatest(0, CAST(floor(count(*) * 99 / 100) AS BIGINT) - 1) + 1] AS p99,
        coalesce(any_value(thr), 0.0) AS throughput
    FROM (SELECT ticker AS operation, price FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts_ms DESC, event_id DESC) <= 100)
    LEFT JOIN (SELECT ticker AS operation, CASE WHEN now > min(ts_ms) THEN sum(volume) / ((now - min(ts_ms)) / 1000.0::DOUBLE)
            ELSE CAST(sum(volume) AS DOUBLE) END AS thr
        FROM ticks, (SELECT max(ts_ms) AS now FROM ticks) WHERE ts_ms >= now - 7200000 GROUP BY ticker, now) USING (operation)
    GROUP BY operation""", "ticks"))
def latency_stats(spark, sf):
    return monitoring.latency_stats(operations(spark, sf), ["ended_ms", "event_id"], window_s=7200)


@add("A32_operation_alerts", "event_id:l alerts:s", sql("""
    SELECT event_id, concat_ws(',', CASE WHEN price > 100 THEN 'latency' END,
        CASE WHEN price > 0 AND volume / nullif(price, 0) < 0.5 THEN 'throughput' END,
        CASE WHEN volume > 95 THEN 'memory' END) AS alerts FROM ticks""", "ticks"))
def operation_alerts(spark, sf):
    ops = operations(spark, sf).withColumn("memory_mb", F.col("records"))
    return monitoring.operation_alerts(ops, 100.0, 0.5, 95.0).withColumn("alerts", F.concat_ws(",", "alerts"))


@add("A33_latency_percentiles", "operation:s mean:d p50:d p95:d p99:d max:d meets_target:b", sql("""
    SELECT ticker AS operation, avg(price) AS mean, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.95) AS p95,
        quantile_cont(price, 0.99) AS p99, max(price) AS max, quantile_cont(price, 0.99) < 100 AS meets_target
    FROM ticks GROUP BY ticker""", "ticks"))
def latency_percentiles(spark, sf):
    return monitoring.latency_percentiles(operations(spark, sf), "seconds", ["operation"])


def error_events(spark, sf):
    t = views.ticks(spark, sf)
    return t.select("ts_ms", "event_id", F.col("ticker").alias("error_type"), (F.col("price") > 60).alias("is_error"))


@add("A34_error_rate", "ts_ms:l total:l errors:l rate_pct:d alert:b", sql("""
    SELECT DISTINCT ts_ms, total, errors, errors * 100.0::DOUBLE / total AS rate_pct, errors * 100.0::DOUBLE / total > 1 AS alert
    FROM (SELECT ts_ms, count(*) OVER w AS total, count(*) FILTER (price > 60) OVER w AS errors FROM ticks
          WINDOW w AS (ORDER BY ts_ms RANGE BETWEEN 900000 PRECEDING AND CURRENT ROW))""", "ticks"))
def error_rate(spark, sf):
    return monitoring.error_rate(error_events(spark, sf))


@add("A35_error_summary", "error_type:s errors:l", sql(
    "SELECT ticker AS error_type, count(*) AS errors FROM ticks WHERE price > 60 GROUP BY ticker", "ticks"))
def error_summary(spark, sf):
    return monitoring.error_summary(error_events(spark, sf))


@add("A35_recent_errors", "error_type:s event_id:l ts_ms:l", sql("""
    SELECT ticker AS error_type, event_id, ts_ms FROM ticks WHERE price > 60
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts_ms DESC, event_id DESC) <= 50""", "ticks"))
def recent_errors(spark, sf):
    return monitoring.recent_errors(error_events(spark, sf), ["ts_ms", "event_id"])


@add("A36_ingest_stats", "source:s fetched:l valid:l invalid:l duplicates:l written:l", sql(f"""
    SELECT source, sum(n) AS fetched, sum(v) AS valid, sum(n - v) AS invalid, sum(greatest(v - 1, 0)) AS duplicates,
        count(*) FILTER (v > 0) AS written
    FROM (SELECT source, l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER ({_rules_sql("equity")} = '') AS v
          FROM records GROUP BY ALL) GROUP BY source""", records=RECORDS_SQL))
def ingest_stats(spark, sf):
    return monitoring.ingest_stats(validate(records(spark, sf), "equity"), ["l_orderkey", "l_linenumber"], ["source"])


@add("A37_event_dashboard",
     "date:s option_type:s events:l median_minutes_to_trigger:d median_gain_pct:d median_above_20:d median_above_10:d", sql("""
    SELECT date, option_type, count(*) AS events, median(minutes_to_trigger) AS median_minutes_to_trigger,
        median(gain_pct) AS median_gain_pct, median(above_20pct_duration_min) AS median_above_20,
        median(above_10pct_duration_min) AS median_above_10 FROM ev GROUP BY ALL""", "optbars", ev=EVENTS_SQL))
def event_dashboard(spark, sf):
    return scanners.event_dashboard(events_like(spark, sf))


@add("A38_session_health", "session:s ts_ms:l price:d age_ms:l is_stale:b", sql("""
    SELECT ticker AS session, max(ts_ms) AS ts_ms, arg_max(price, ts_ms) AS price, (SELECT max(ts_ms) FROM ticks) - max(ts_ms) AS age_ms,
        (SELECT max(ts_ms) FROM ticks) - max(ts_ms) > 900000 AS is_stale FROM ticks GROUP BY ticker""", "ticks"))
def session_health(spark, sf):
    t = views.ticks(spark, sf).select(F.col("ticker").alias("session"), "ts_ms", "price")
    return monitoring.session_health(t, t.agg(F.max("ts_ms")).scalar())
