"""Window and sequence functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.calendar import session_minutes
from ..operators import balance, explain, labels, monitoring, quality, ranking, risk, scanners, selection, splits
from ..operators.labels import future_price_vector
from ..sources import views
from .aggregates import LABELS_SQL, SPLIT_SQL, WALK_SQL, labelled
from .base import Catalog, bollinger_sql, ewm_sql, macd_sql, rsi_sql, sql
from .joins import index_bars, underlying_bars
from .predicates import CONTRIBUTIONS_SQL, DAILY_OPENS_SQL, ET_SQL, IMPACTS, daily_opens, wide_impacts

CATALOG = Catalog()
add = CATALOG.add

_KEY = "ticker:s trade_date:s ts_ms:l"
_W = "(PARTITION BY ticker, trade_date ORDER BY ts_ms)"
_BY = "ticker, trade_date"
_MSO = f"SELECT *, hour({ET_SQL}) * 60 + minute({ET_SQL}) - 570 AS mso FROM bars"


def clocked(spark, sf):
    return views.bars(spark, sf).withColumn("minutes_since_open", session_minutes(F.col("ts_ms")))


def _gated(expr: str, n: int) -> str:
    return f"CASE WHEN mso >= {n} THEN {expr} ELSE 0.0 END"


def _pct(x: str, n: int) -> str:
    return f"({x} - lag({x}, {n}) OVER {_W}) / nullif(CAST(lag({x}, {n}) OVER {_W} AS DOUBLE), 0) * 100"


_LAGS = (1, 5, 10, 15)
_RETS = (1, 5, 15, 30, 60)


@add("W1_lag_pct_change", f"{_KEY} " + " ".join(f"price_change_{n}m:d volume_change_{n}m:d" for n in _LAGS), sql(
    "SELECT *, " + ", ".join(f"{_gated(_pct('close', n), n)} AS price_change_{n}m, {_gated(_pct('volume', n), n)} AS volume_change_{n}m"
                             for n in _LAGS) + " FROM c", "bars", c=_MSO))
def lag_pct_change(spark, sf):
    w = ind.series_window()
    return ind.layered(clocked(spark, sf), ind.lag_change("close", "price_change", _LAGS, w),
                       ind.lag_change("volume", "volume_change", _LAGS, w))


@add("W2_lag_pct_change_options", f"{_KEY} " + " ".join(f"price_change_{n}m:d iv_change_{n}m:d" for n in _LAGS), sql(
    "SELECT *, " + ", ".join(f"{_gated(_pct('close', n), n)} AS price_change_{n}m, {_gated(_pct('vwap', n), n)} AS iv_change_{n}m"
                             for n in _LAGS) + " FROM c WHERE ticker IN ('purchase', 'signup')", "bars", c=_MSO))
def lag_pct_change_options(spark, sf):
    """Gated changes of two measures on option series; VWAP stands in for the volatility."""
    w, b = ind.series_window(), clocked(spark, sf).where(F.col("ticker").isin("purchase", "signup"))
    return ind.layered(b, ind.lag_change("close", "price_change", _LAGS, w), ind.lag_change("vwap", "iv_change", _LAGS, w))


@add("W3_change_from_first", f"{_KEY} change:d", sql(
    f"""SELECT *, CASE WHEN first_value(close) OVER {_W} > 0 THEN (close - first_value(close) OVER {_W})
        / first_value(close) OVER {_W} * 100 END AS change FROM bars""", "bars"))
def change_from_first(spark, sf):
    return views.bars(spark, sf).withColumn("change", ind.change_from_first("close", ind.series_window()))


@add("W4_log_return", f"{_KEY} " + " ".join(f"ret_{n}m:d" for n in _RETS), sql(
    "SELECT *, " + ", ".join(_gated(f"CASE WHEN close > 0 AND lag(close, {n}) OVER {_W} > 0 THEN ln(close / lag(close, {n}) OVER {_W}) * 100 END", n)
                             + f" AS ret_{n}m" for n in _RETS) + " FROM c", "bars", c=_MSO))
def log_return(spark, sf):
    return ind.layered(clocked(spark, sf), ind.log_return("close", "ret", _RETS, ind.series_window()))


@add("W5_momentum", f"{_KEY} " + " ".join(f"price_change_{n}:d roc_{n}:d" for n in (5, 30, 60)), sql(
    "SELECT *, " + ", ".join(f"close - lag(close, {n}) OVER {_W} AS price_change_{n}, (close - lag(close, {n}) OVER {_W}) / "
                             f"nullif(lag(close, {n}) OVER {_W}, 0) AS roc_{n}" for n in (5, 30, 60)) + " FROM bars", "bars"))
def momentum(spark, sf):
    return ind.layered(views.bars(spark, sf), ind.momentum("close", (5, 30, 60), ind.series_window()))


@add("W6_rolling_mean", f"{_KEY} ma5:d ratio5:d ma30:d ratio30:d", sql("""
    SELECT *, volume / nullif(ma5, 0) AS ratio5, volume / nullif(ma30, 0) AS ratio30 FROM (SELECT *,
        avg(volume) OVER (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS 4 PRECEDING) AS ma5,
        avg(volume) OVER (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS 29 PRECEDING) AS ma30 FROM bars)""", "bars"))
def rolling_mean(spark, sf):
    w = ind.series_window()
    return ind.layered(views.bars(spark, sf), ind.rolling_mean("volume", 5, "ma5", w, "ratio5"),
                       ind.rolling_mean("volume", 30, "ma30", w, "ratio30"))


@add("W7_rolling_zscore", f"{_KEY} z:d", sql("""
    SELECT *, CASE WHEN count(volume) OVER w >= 5 THEN (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) END AS z
    FROM bars WINDOW w AS (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS 29 PRECEDING)""", "bars"))
def rolling_zscore(spark, sf):
    return views.bars(spark, sf).withColumn("z", ind.rolling_zscore("volume", 30, 5, ind.series_window()))


@add("W8_return_volatility", f"{_KEY} sd5:d sd30:d", sql(f"""
    SELECT *, CASE WHEN count(r) OVER a >= 2 THEN stddev_samp(r) OVER a END AS sd5,
        CASE WHEN count(r) OVER b >= 2 THEN stddev_samp(r) OVER b END AS sd30
    FROM (SELECT *, CASE WHEN close > 0 AND lag(close) OVER {_W} > 0 THEN ln(close / lag(close) OVER {_W}) * 100 END AS r FROM bars)
    WINDOW a AS (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS 4 PRECEDING),
        b AS (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS 29 PRECEDING)""", "bars"))
def return_volatility(spark, sf):
    return ind.layered(views.bars(spark, sf), ind.return_volatility("close", {5: "sd5", 30: "sd30"}, ind.series_window()))


@add("W9_hl_range", f"{_KEY} hl5:d hl30:d", sql("""
    SELECT *, (max(high) OVER a - min(low) OVER a) / nullif(close, 0) * 100 AS hl5,
        (max(high) OVER b - min(low) OVER b) / nullif(close, 0) * 100 AS hl30 FROM bars
    WINDOW a AS (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS 4 PRECEDING),
        b AS (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS 29 PRECEDING)""", "bars"))
def hl_range(spark, sf):
    w = ind.series_window()
    return (views.bars(spark, sf).withColumn("hl5", ind.hl_range("high", "low", "close", 5, w))
            .withColumn("hl30", ind.hl_range("high", "low", "close", 30, w)))


@add("W10_rsi", f"{_KEY} rsi:d", sql(f"""
    SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY {_BY}) >= 14 THEN rsi END AS rsi)
    FROM ({rsi_sql("bars", "close", "rsi", _BY)})""", "bars"))
def rsi(spark, sf):
    w = ind.series_window()
    return ind.layered(views.bars(spark, sf), ind.after(ind.rsi("close", "rsi", w), ind.blank_short(["rsi"], ind.RSI_PERIOD, w)))


@add("W11_ema", f"{_KEY} ema_9:d ema_21:d ema_diff:d", sql(
    f"SELECT *, ema_9 - ema_21 AS ema_diff FROM ({ewm_sql('(' + ewm_sql('bars', 'close', 'ema_9', 2 / 10, 9, _BY) + ')', 'close', 'ema_21', 2 / 22, 21, _BY)})", "bars"))
def ema(spark, sf):
    w = ind.series_window()
    out = ind.layered(views.bars(spark, sf), ind.ema("close", 9, "ema_9", w), ind.ema("close", 21, "ema_21", w))
    return out.withColumn("ema_diff", F.col("ema_9") - F.col("ema_21"))


@add("W12_macd", f"{_KEY} macd:d macd_signal:d macd_hist:d", sql(
    macd_sql("bars", "close", "macd", "macd_signal", "macd_hist", _BY), "bars"))
def macd(spark, sf):
    return ind.layered(views.bars(spark, sf), ind.macd("close", "macd", "macd_signal", "macd_hist", ind.series_window()))


@add("W13_bollinger", f"{_KEY} bb_upper:d bb_middle:d bb_lower:d bb_width:d bb_pct_b:d", sql(
    bollinger_sql("bars", "close", "bb", _BY), "bars"))
def bollinger(spark, sf):
    return ind.layered(views.bars(spark, sf), ind.bollinger("close", "bb", ind.series_window()))


@add("W14_ffill_bfill", f"{_KEY} rsi:d ema_21:d", sql(f"""
    SELECT * REPLACE (coalesce(last_value(rsi IGNORE NULLS) OVER p, first_value(rsi IGNORE NULLS) OVER f) AS rsi,
        coalesce(last_value(ema_21 IGNORE NULLS) OVER p, first_value(ema_21 IGNORE NULLS) OVER f) AS ema_21)
    FROM ({ewm_sql("(" + rsi_sql("bars", "close", "rsi", _BY) + ")", "close", "ema_21", 2 / 22, 21, _BY)})
    WINDOW p AS (PARTITION BY {_BY} ORDER BY ts_ms ROWS UNBOUNDED PRECEDING),
        f AS (PARTITION BY {_BY} ORDER BY ts_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "bars"))
def ffill_bfill(spark, sf):
    w = ind.series_window()
    both = ind.beside(ind.rsi("close", "rsi", w), ind.ema("close", 21, "ema_21", w))
    return ind.layered(views.bars(spark, sf), ind.after(both, ind.fill_both_ways(["rsi", "ema_21"], w)))


@add("W15_cum_share", f"{_KEY} share:d", sql("""
    SELECT *, sum(volume) OVER (PARTITION BY ticker, trade_date ORDER BY ts_ms ROWS UNBOUNDED PRECEDING)
        / CAST(sum(volume) OVER (PARTITION BY ticker, trade_date) AS DOUBLE) AS share FROM bars""", "bars"))
def cum_share(spark, sf):
    return views.bars(spark, sf).withColumn("share", ind.cumulative_share("volume", ind.series_window()))


@add("W16_bar_counter", f"{_KEY} bar_count:l", sql(f"SELECT *, row_number() OVER {_W} AS bar_count FROM bars", "bars"))
def bar_counter(spark, sf):
    return views.bars(spark, sf).withColumn("bar_count", ind.bar_counter(ind.series_window()))


@add("W17_iv_change", f"{_KEY} change_1:d change_5:d change_open:d", sql(
    f"""SELECT *, {_pct('vwap', 1)} AS change_1, {_pct('vwap', 5)} AS change_5, CASE WHEN first_value(vwap) OVER {_W} > 0 THEN
        (vwap - first_value(vwap) OVER {_W}) / first_value(vwap) OVER {_W} * 100 END AS change_open FROM bars""", "bars"))
def iv_change(spark, sf):
    """Ungated changes; VWAP stands in for the volatility."""
    w = ind.series_window()
    return (views.bars(spark, sf).withColumn("change_1", ind.plain_change("vwap", 1, w))
            .withColumn("change_5", ind.plain_change("vwap", 5, w))
            .withColumn("change_open", ind.change_from_first("vwap", w)))


@add("W18_forward_labels", f"{_KEY} max_gain_120m:d time_to_max_min:d target:l", sql("SELECT * FROM l", "bars", l=LABELS_SQL))
def forward_labels(spark, sf):
    return labels.forward_labels(views.bars(spark, sf), with_loss=False)


@add("W19_forward_min_loss", f"{_KEY} min_loss_120m:d", sql("SELECT * FROM l", "bars", l=LABELS_SQL))
def forward_min_loss(spark, sf):
    return labelled(spark, sf)


@add("W20_target_coverage_filter", f"{_KEY} close:d filled:l", sql("""
    SELECT b.*, count(*) AS filled FROM bars b JOIN bars f ON f.ticker = b.ticker AND f.trade_date = b.trade_date
        AND f.ts_ms > b.ts_ms AND f.ts_ms <= b.ts_ms + 7200000 GROUP BY ALL HAVING count(*) >= 4""", "bars"))
def coverage_filter(spark, sf):
    v = labels.target_coverage_filter(future_price_vector(views.bars(spark, sf), 8, views.BAR_MS))
    return v.withColumn("filled", F.size(F.filter("target_future_prices", lambda x: x.isNotNull())))




_LISTS = "SELECT ticker, trade_date, list(close ORDER BY ts_ms) AS c, list(ts_ms ORDER BY ts_ms) AS ts, count(*) AS n FROM bars GROUP BY ALL"
_ET = "strftime(make_timestamp(ts[{}] * 1000) - INTERVAL 5 HOUR, '%H:%M:%S')"
# One bar per step; (rp, ri, ti, a20, a10) describe the running event.
_BACK_CHAIN = """SELECT ticker, trade_date, c, ts, n, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS floor, false AS active, false AS ended,
        CAST(NULL AS DOUBLE) AS rp, CAST(NULL AS BIGINT) AS ri, CAST(NULL AS BIGINT) AS ti, CAST(NULL AS BIGINT) AS a20, CAST(NULL AS BIGINT) AS a10
    FROM lists
    UNION ALL
    SELECT ticker, trade_date, c, ts, n, k AS i, CASE WHEN active AND x < rp * 1.1::DOUBLE THEN k + 1 ELSE floor END,
        CASE WHEN active THEN x >= rp * 1.1::DOUBLE ELSE fires END, active AND x < rp * 1.1::DOUBLE,
        CASE WHEN active THEN rp WHEN fires THEN low END, CASE WHEN active THEN ri WHEN fires THEN lo - 1 + list_position(past, low) END,
        CASE WHEN active THEN ti WHEN fires THEN k END,
        CASE WHEN active THEN a20 + CAST(x >= rp * 1.2::DOUBLE AS BIGINT) WHEN fires THEN 1 END,
        CASE WHEN active THEN a10 + CAST(x >= rp * 1.1::DOUBLE AS BIGINT) WHEN fires THEN 1 END
    FROM (SELECT *, coalesce(NOT active AND len(past) > 0 AND low > 0 AND x >= low * 1.2::DOUBLE, false) AS fires FROM (
        SELECT *, list_min(past) AS low FROM (SELECT *, c[lo:k - 1] AS past FROM (
        SELECT *, i + 1 AS k, c[i + 1] AS x, greatest(floor, i + 1 - 8) AS lo FROM chain WHERE i < n))))"""
_FORWARD_CHAIN = """SELECT ticker, trade_date, c, ts, n, CAST(0 AS BIGINT) AS e, CAST(NULL AS BIGINT) AS j, CAST(NULL AS BIGINT) AS stop, CAST(1 AS BIGINT) AS nxt FROM lists
    UNION ALL
    SELECT ticker, trade_date, c, ts, n, e, j, coalesce(brk, n + 1) AS stop, CASE WHEN j IS NULL THEN e + 1 ELSE coalesce(brk, n) + 1 END
    FROM (SELECT *, list_filter(range(j, n + 1), lambda q: c[q] < c[e] * 1.1::DOUBLE)[1] AS brk FROM (
        SELECT ticker, trade_date, c, ts, n, nxt AS e,
            CASE WHEN c[nxt] > 0 THEN list_filter(range(nxt + 1, least(nxt + 8, n) + 1), lambda q: c[q] >= c[nxt] * 1.2::DOUBLE)[1] END AS j
        FROM chain WHERE nxt <= n))"""


@add("W21_scan_backward",
     "date:s ticker:s trigger_time_et:s reference_time_et:s gain_pct:d2 above_20pct_duration_min:l above_10pct_duration_min:l "
     "reference_price:d4 trigger_price:d4", sql(f"""
    SELECT trade_date AS date, ticker, {_ET.format("ti")} AS trigger_time_et, {_ET.format("ri")} AS reference_time_et,
        (c[ti] - rp) / rp * 100 AS gain_pct, a20 AS above_20pct_duration_min, a10 AS above_10pct_duration_min,
        rp AS reference_price, c[ti] AS trigger_price FROM chain WHERE ended OR (active AND i = n)""",
    "bars", lists=_LISTS, chain=_BACK_CHAIN))
def scan_backward(spark, sf):
    return scanners.scan_backward(views.bars(spark, sf), window=8)


@add("W22_scan_forward",
     "date:s ticker:s entry_time_et:s trigger_time_et:s minutes_to_trigger:l gain_pct:d2 above_20pct_duration_min:l "
     "above_10pct_duration_min:l entry_price:d4 trigger_price:d4", sql(f"""
    SELECT trade_date AS date, ticker, {_ET.format("e")} AS entry_time_et, {_ET.format("j")} AS trigger_time_et, j - e AS minutes_to_trigger,
        (c[j] - c[e]) / c[e] * 100 AS gain_pct, len(list_filter(c[j:stop - 1], lambda v: v >= c[e] * 1.2::DOUBLE)) AS above_20pct_duration_min,
        len(list_filter(c[j:stop - 1], lambda v: v >= c[e] * 1.1::DOUBLE)) AS above_10pct_duration_min, c[e] AS entry_price, c[j] AS trigger_price
    FROM chain WHERE j IS NOT NULL""", "bars", lists=_LISTS, chain=_FORWARD_CHAIN))
def scan_forward(spark, sf):
    return scanners.scan_forward(views.bars(spark, sf), window=8)


@add("W23_chronological_split", "l_orderkey:l l_linenumber:l l_partkey:l split:s", sql(
    "SELECT * FROM scored JOIN sp USING (date)", "scored", sp=SPLIT_SQL))
def chronological_split(spark, sf):
    return splits.chronological_split(views.scored(spark, sf))


@add("W23_row_split", "l_orderkey:l l_linenumber:l l_partkey:l split:s", sql("""
    SELECT *, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train' WHEN i < floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER () AS n
          FROM scored)""", "scored"))
def row_split(spark, sf):
    return splits.chronological_split(views.scored(spark, sf).drop("date"), tie=views.ROW_KEY)


@add("W24_split_dates", "date:s split:s", sql("SELECT * FROM sp", "scored", sp=SPLIT_SQL))
def split_dates(spark, sf):
    return splits.split_dates(views.scored(spark, sf))


@add("W25_walk_forward_splits", "split_index:l train_start:s train_end:s test_start:s test_end:s", sql(
    "SELECT * FROM walk", "scored", walk=WALK_SQL))
def walk_forward_splits(spark, sf):
    return splits.walk_forward_splits(views.scored(spark, sf))


@add("W26_fit_val_split", "date:s part:s n:l", sql("""
    SELECT date, CASE WHEN n >= 5 AND i > floor(n * 0.80::DOUBLE) THEN 'val' ELSE 'fit' END AS part, c AS n FROM (
    SELECT date, count(*) AS c, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM scored GROUP BY date)""", "scored"))
def fit_val_split(spark, sf):
    out = splits.fit_val_split(views.scored(spark, sf))
    return out.groupBy("date", "part").agg(F.count(F.lit(1)).alias("n"))


@add("W27_timeseries_folds", "fold:l role:s n:l first_ts:l last_ts:l keys:l", sql("""
    SELECT f AS fold, CASE WHEN i < n - (5 - f) * (n // 6) THEN 'train' ELSE 'test' END AS role, count(*) AS n,
        min(timestamp) AS first_ts, max(timestamp) AS last_ts, sum(l_orderkey) AS keys
    FROM (SELECT *, row_number() OVER (ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i,
          count(*) OVER () AS n FROM scored), (SELECT unnest(range(5)) AS f)
    WHERE i < n - (5 - f) * (n // 6) + n // 6 GROUP BY ALL""", "scored"))
def timeseries_folds(spark, sf):
    out = splits.timeseries_folds(views.scored(spark, sf), 5, tie=views.ROW_KEY)
    return out.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.sum("l_orderkey").alias("keys"))


@add("W28_sliding_sequences", f"{_KEY} label:l sequence:s", sql("""
    SELECT *, target AS label, list_reduce(list_transform(seq, lambda x: CAST(x.v AS VARCHAR) || '/' || CAST(x.t AS VARCHAR)), lambda a, b: a || ' ' || b) AS sequence
    FROM (SELECT *, list({'v': volume, 't': transactions}) OVER (PARTITION BY ticker, trade_date ORDER BY ts_ms
        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS seq FROM l) WHERE len(seq) = 5""", "bars", l=LABELS_SQL))
def sliding_sequences(spark, sf):
    out = splits.sliding_sequences(labelled(spark, sf), ["volume", "transactions"], 5, ind.SERIES, "ts_ms")
    flat = F.concat_ws(" ", F.transform("sequence", lambda r: F.concat_ws("/", F.transform(r, lambda v: v.cast("int").cast("string")))))
    return out.withColumn("sequence", flat)


@add("W29_top_impacts", "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l rank:l feature:s direction:s is_risk:b strength:l", sql("""
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY abs(impact) DESC, feature) AS rank,
        CASE WHEN impact > 0 THEN 'bullish' ELSE 'bearish' END AS direction, impact < 0 AS is_risk,
        least(5, greatest(1, CAST(floor(abs(impact) * 20) AS BIGINT))) AS strength FROM c QUALIFY rank <= 2""", "scored", c=CONTRIBUTIONS_SQL))
def top_impacts(spark, sf):
    return explain.top_impacts(wide_impacts(spark, sf), views.ROW_KEY, IMPACTS, 2)


@add("W29_signal_cautions", "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l margin:d near_threshold:b risk_factors:l caution:b", sql("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(proba) - 0.7 AS margin, abs(max(proba) - 0.7::DOUBLE) < 0.02::DOUBLE AS near_threshold,
        count(*) FILTER (impact < 0) AS risk_factors, count(*) FILTER (impact < 0) >= 2 AS caution
    FROM c GROUP BY ALL""", "scored", c=CONTRIBUTIONS_SQL))
def signal_cautions(spark, sf):
    return explain.signal_cautions(wide_impacts(spark, sf), views.ROW_KEY, IMPACTS, 0.7)


def sample_sql(src: str, by: str = "") -> str:
    """As many rows of the larger class of ``src`` as the smaller has, for each ``by``."""
    key = f"{by}, " if by else ""
    return f"""SELECT * EXCLUDE (_c) FROM (SELECT *, count(*) OVER (PARTITION BY {key}target) AS _c FROM {src})
        QUALIFY row_number() OVER (PARTITION BY {key}target ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey
            || '|' || l_suppkey)) <= min(_c) OVER ({f"PARTITION BY {by}" if by else ""})"""


_SAMPLE_SQL = sample_sql("scored")


@add("W30_undersample_majority", "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l target:l", sql(_SAMPLE_SQL, "scored"))
def undersample_majority(spark, sf):
    return balance.undersample_majority(views.scored(spark, sf), views.ROW_KEY)


@add("W31_balance", "method:s target:l n:l keys:l", sql(f"""
    SELECT 'undersample' AS method, target, count(*) AS n, sum(l_orderkey) AS keys FROM ({_SAMPLE_SQL}) GROUP BY target
    UNION ALL SELECT 'class_weights', target, count(*), sum(l_orderkey) FROM scored GROUP BY target""", "scored"))
def balance_methods(spark, sf):
    s = views.scored(spark, sf)
    parts = [balance.balance(s, m, views.ROW_KEY).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")).withColumn("method", F.lit(m))
        for m in ("undersample", "class_weights")]
    return parts[0].unionByName(parts[1])


@add("K1_sorted_output", f"{_KEY} position:l", sql(
    "SELECT *, row_number() OVER (ORDER BY ts_ms, ticker) - 1 AS position FROM bars", "bars"))
def sorted_output(spark, sf):
    """Global order by (timestamp, ticker) as a position, without a single-task sort."""
    return ranking.global_position(views.bars(spark, sf), "ts_ms", ["ticker"])


@add("K2_top_features", "feature:s importance:d share:d rank:l", """
    SELECT feature, importance, importance / sum(importance) OVER () AS share,
        row_number() OVER (ORDER BY importance DESC, feature) AS rank
    FROM (SELECT p_name AS feature, sum(p_retailprice) AS importance FROM part GROUP BY p_name) QUALIFY rank <= 5""")
def top_features(spark, sf):
    p = views.table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return risk.importance_table(p, top=5)


@add("K3_argmax_probability", "l_linestatus:s l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l proba:d", sql("""
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY proba DESC, l_orderkey DESC,
        l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""", "scored"))
def argmax_probability(spark, sf):
    s = views.scored(spark, sf).select("l_linestatus", *views.ROW_KEY, "proba")
    return monitoring.last_n(s, ["l_linestatus"], ["proba", *views.ROW_KEY], 1)


@add("K4_first_expiry", "trade_date:s expiration_date:s", sql("""
    SELECT o.trade_date, min(c.expiration_date) AS expiration_date FROM opens o JOIN contracts c
        ON CAST(c.expiration_date AS DATE) BETWEEN CAST(o.trade_date AS DATE) + 1 AND CAST(o.trade_date AS DATE) + 5
        AND c.strike_price BETWEEN opening_price - 2 AND opening_price + 2 GROUP BY o.trade_date""", "contracts", opens=DAILY_OPENS_SQL))
def first_expiry(spark, sf):
    spot = F.col("opening_price")
    ranges = daily_opens(spark, sf).select("trade_date", (spot - 2).alias("lo"), (spot + 2).alias("hi"))
    return selection.first_expiry(views.contracts(spark, sf), ranges)


@add("U1_union_frames", "kind:s trade_date:s ts_ms:l close:d volume:l", sql("""
    SELECT 'underlying' AS kind, trade_date, ts_ms, close, volume FROM und
    UNION ALL SELECT 'index', trade_date, ts_ms, close, NULL FROM idx""", "und", "idx"))
def union_frames(spark, sf):
    return (underlying_bars(spark, sf).withColumn("kind", F.lit("underlying"))
            .unionByName(index_bars(spark, sf).withColumn("kind", F.lit("index")), allowMissingColumns=True))


@add("U2_dedup_last", "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l l_extendedprice:d", """
    SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def dedup_last(spark, sf):
    return quality.dedup_last(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                              ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])


@add("U3_signal_sets", "op:s ticker:s entry:l", sql("""
    SELECT 'union' AS op, * FROM (SELECT ticker, timestamp AS entry FROM scored WHERE proba >= 0.8
        UNION SELECT ticker, timestamp FROM scored WHERE proba_b >= 0.8)
    UNION ALL SELECT 'intersect', * FROM (SELECT ticker, timestamp FROM scored WHERE proba >= 0.8
        INTERSECT SELECT ticker, timestamp FROM scored WHERE proba_b >= 0.8)""", "scored"))
def signal_sets(spark, sf):
    s = views.scored(spark, sf)
    a, b = (s.where(F.col(c) >= 0.8).select("ticker", F.col("timestamp").alias("entry")) for c in ("proba", "proba_b"))
    return (a.union(b).distinct().withColumn("op", F.lit("union"))
            .unionByName(a.intersect(b).withColumn("op", F.lit("intersect"))))


_BASELINE = {"o_orderkey": "bigint", "o_custkey": "string", "o_orderstatus": "string", "o_totalprice": "double",
             "o_clerk": "string", "o_orderpriority": "string"}


def drift_sql(table: str, baseline: dict[str, str]) -> str:
    """Differences between the table's own description and a baseline, with its row count."""
    known = ", ".join(f"('{c}', '{t}')" for c, t in baseline.items())
    return f"""SELECT CASE WHEN b.c IS NULL THEN 'new_column' WHEN now.c IS NULL THEN 'missing_column' ELSE 'type_change' END AS kind,
        coalesce(now.c, b.c) AS "column", b.t AS expected, now.t AS actual, (SELECT count(*) FROM {table}) AS n
    FROM (SELECT column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
          WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS t FROM (DESCRIBE {table})) now
    FULL JOIN (VALUES {known}) AS b(c, t) ON now.c = b.c WHERE now.t IS DISTINCT FROM b.t"""


@add("U4_schema_difference", "kind:s column:s n:l", drift_sql("orders", _BASELINE))
def schema_difference(spark, sf):
    """Drift alerts of the orders table with the rows each one touches."""
    o = views.table(spark, sf, "orders")
    alerts = quality.schema_drift(spark, o.schema, _BASELINE)
    return alerts.withColumn("n", o.agg(F.count(F.lit(1))).scalar())
