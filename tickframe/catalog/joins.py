"""Joins (J1-J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flatten
from ..operators.asof import asof_grid, asof_join
from ..operators.balance import attach_class_weight, class_weights
from ..operators.bars import opening_price, resample_ohlc, resample_ohlcv, resample_options
from ..operators.compare import signal_overlap
from ..operators.labels import future_price_vector
from ..operators.selection import targeted_selection
from ..operators.trades import trade_outcomes
from ..plans.consolidate import DAY, align_index, attach_news
from ..sources import views
from .base import Catalog, sql
from .predicates import DAILY_OPENS_SQL, daily_opens

CATALOG = Catalog()
add = CATALOG.add


def underlying_bars(spark, sf):
    return resample_ohlcv(views.underlying_ticks(spark, sf), DAY, views.BAR_MS, order="event_id")


def index_bars(spark, sf):
    return resample_ohlc(views.index_ticks(spark, sf), DAY, views.BAR_MS, order="event_id")


@add("J1_asof_join", "trade_date:s ts_ms:l close:d vix_open:d vix_close:d", sql("""
    SELECT und.*, idx.open AS vix_open, idx.close AS vix_close FROM und ASOF LEFT JOIN idx
        ON und.trade_date = idx.trade_date AND und.ts_ms >= idx.ts_ms""", "und", "idx"))
def asof_bars(spark, sf):
    return align_index(underlying_bars(spark, sf), index_bars(spark, sf), grid_ms=views.BAR_MS)


@add("J1_asof_join_ticks", "event_id:l trade_date:s ts_ms:l price:d view_id:l view_price:d", sql("""
    SELECT t.*, u.event_id AS view_id, u.price AS view_price FROM ticks t
        ASOF LEFT JOIN (SELECT * FROM ticks WHERE ticker = 'view') u
        ON t.trade_date = u.trade_date AND t.ts_ms >= u.ts_ms""", "ticks"))
def asof_ticks(spark, sf):
    """Raw ticks: sliced by the hour, with the last right tick carried between slices."""
    right = views.underlying_ticks(spark, sf).select(
        "trade_date", "ts_ms", F.col("event_id").alias("view_id"), F.col("price").alias("view_price"))
    return asof_join(views.ticks(spark, sf), right, tie="view_id", slice_width=3_600_000)


@add("J2_asof_tolerance", "trade_date:s ts_ms:l close:d news_article_id:l news_sentiment:s news_sentiment_reasoning:s", sql("""
    SELECT und.*, CASE WHEN ok THEN article_id END AS news_article_id, CASE WHEN ok THEN sentiment END AS news_sentiment,
        CASE WHEN ok THEN sentiment_reasoning END AS news_sentiment_reasoning FROM (
        SELECT und.*, n.article_id, n.sentiment, n.sentiment_reasoning, und.ts_ms - n.ts_ms <= 1800000 AS ok
        FROM und ASOF LEFT JOIN news n ON und.trade_date = n.trade_date AND und.ts_ms >= n.ts_ms) AS und""", "und", "news"))
def asof_news(spark, sf):
    return attach_news(underlying_bars(spark, sf), views.news(spark, sf), 1_800_000, views.BAR_MS)


@add("J3_asof_many_series", "ticker:s trade_date:s ts_ms:l close:d u_close:d u_volume:l", sql("""
    SELECT b.*, u.close AS u_close, u.volume AS u_volume FROM bars b ASOF LEFT JOIN und u
        ON b.trade_date = u.trade_date AND b.ts_ms >= u.ts_ms""", "bars", "und"))
def asof_series(spark, sf):
    side = underlying_bars(spark, sf).select("trade_date", "ts_ms", F.col("close").alias("u_close"),
                                             F.col("volume").alias("u_volume"))
    return asof_grid(views.bars(spark, sf), side, views.BAR_MS)


def option_side(spark, sf):
    opts = resample_options(views.option_ticks(spark, sf), width_ms=views.BAR_MS, order="event_id")
    return flatten.option_rows(opts, views.event_contracts(spark, sf))


OPTION_SIDE_SQL = """SELECT o.trade_date, o.ts_ms, o.ticker, t.contract_type, t.strike_price, o.option_avg_price,
    (epoch_ms(CAST(t.expiration_date AS TIMESTAMP)) - o.ts_ms) / 86400000.0::DOUBLE AS time_to_expiry_days
    FROM (SELECT trade_date, ticker, ts_ms - ts_ms % 900000 AS ts_ms, avg(price) AS option_avg_price FROM ticks
          WHERE ticker IN ('purchase', 'signup') GROUP BY ALL) o
    JOIN terms t ON o.trade_date = t.trade_date AND o.ticker = t.ticker"""

_FLAT = "trade_date:s ts_ms:l close:d ticker:s contract_type:s strike_price:d time_to_expiry_days:d12 option_avg_price:d"


@add("J4_flatten_per_option", _FLAT, sql(
    "SELECT * FROM und JOIN opt USING (trade_date, ts_ms)", "und", "terms", opt=OPTION_SIDE_SQL))
def flatten_options(spark, sf):
    return flatten.flatten_per_option(underlying_bars(spark, sf), option_side(spark, sf))


@add("J5_underlying_fallback", _FLAT, sql("""
    SELECT * FROM und JOIN opt USING (trade_date, ts_ms)
    UNION ALL BY NAME SELECT * FROM und WHERE trade_date NOT IN (SELECT trade_date FROM opt)""",
    "und", "terms", opt=f"SELECT * FROM ({OPTION_SIDE_SQL}) WHERE trade_date < '2024-01-21'"))
def flatten_fallback(spark, sf):
    """Option bars of the last days are left out: these days show the fallback."""
    side = option_side(spark, sf).where(F.col("trade_date") < "2024-01-21")
    return flatten.flatten_with_fallback(underlying_bars(spark, sf), side)


TARGETED_SQL = """SELECT trade_date, contract_type, rank, ticker, strike_price, expiration_date FROM (
    SELECT DISTINCT o.trade_date, c.contract_type, c.ticker, c.strike_price, c.expiration_date,
        dense_rank() OVER (PARTITION BY o.trade_date, c.contract_type
            ORDER BY CASE WHEN c.contract_type = 'call' THEN c.strike_price ELSE -c.strike_price END, c.ticker) AS rank
    FROM ranged o JOIN contracts c ON c.expiration_date = o.exp
    JOIN rungs r ON r.trade_date = o.trade_date AND r.contract_type = c.contract_type
        AND abs(c.strike_price - r.strike_price) < 0.01)
    WHERE rank <= CASE WHEN contract_type = 'call' THEN 3 ELSE 2 END"""
RUNGS_SQL = """SELECT *, CASE WHEN i <= 3 THEN 'call' ELSE 'put' END AS contract_type,
    CASE WHEN i <= 3 THEN (floor(opening_price / 0.1 + 1e-9) + i) * 0.1
         ELSE (floor(opening_price / 0.1 + 1e-9) - (i - 3) + 1) * 0.1 END AS strike_price
    FROM opens, (SELECT unnest([1, 2, 3, 4, 5]) AS i)"""
RANGED_SQL = """SELECT g.trade_date, min(c.expiration_date) AS exp FROM
    (SELECT trade_date, min(strike_price) - 1e-7 AS lo, max(strike_price) + 1e-7 AS hi FROM rungs GROUP BY trade_date) g
    JOIN contracts c ON CAST(c.expiration_date AS DATE) > CAST(g.trade_date AS DATE)
        AND CAST(c.expiration_date AS DATE) <= CAST(g.trade_date AS DATE) + 5
        AND c.strike_price BETWEEN lo AND hi GROUP BY g.trade_date"""


@add("J6_targeted_selection", "trade_date:s contract_type:s rank:l ticker:s strike_price:d expiration_date:s", sql(
    TARGETED_SQL, "contracts", opens=DAILY_OPENS_SQL, rungs=RUNGS_SQL, ranged=RANGED_SQL))
def targeted(spark, sf):
    return targeted_selection(views.contracts(spark, sf), daily_opens(spark, sf), 3, 2, 0.1)


VECTOR_SQL = """SELECT ticker, trade_date, ts_ms, k, (SELECT f.close FROM bars f WHERE f.ticker = b.ticker
    AND f.trade_date = b.trade_date AND f.ts_ms = b.ts_ms + k * 900000) AS price
    FROM bars b, (SELECT unnest(range(1, 9)) AS k)"""


@add("J7_future_price_vector", "ticker:s trade_date:s ts_ms:l k:l price:d", sql(VECTOR_SQL, "bars"))
def future_prices(spark, sf):
    v = future_price_vector(views.bars(spark, sf), 8, views.BAR_MS)
    return v.select("ticker", "trade_date", "ts_ms", F.posexplode("target_future_prices").alias("i", "price")).withColumn(
        "k", F.col("i") + 1)


TRADES_SQL = """SELECT *, CASE WHEN down AND up THEN 'Stop-loss (before target)' WHEN up THEN 'Target hit'
        WHEN down THEN 'Stop-loss' ELSE 'Time limit (120 min)' END AS exit_reason,
    round(CASE WHEN down AND up THEN greatest(5.0, peak * 0.3) WHEN up THEN greatest(1.0, peak)
        WHEN down THEN 30.0 ELSE 120.0 END, 1) AS time_in_trade_minutes,
    (exit_price * 100 - close * 100) * num_contracts AS profit_loss_usd,
    (exit_price * 100 - close * 100) / (close * 100) * 100 AS profit_loss_pct,
    (exit_price * 100 - close * 100) * num_contracts > 0 AS is_winner,
    num_contracts * (close * 100) AS actual_position_size,
    date || ' ' || lpad(CAST(hour_et AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute_et AS VARCHAR), 2, '0') || ' ET' AS entry_time
    FROM (SELECT *, round(close * (1 + CASE WHEN down THEN -12.0 WHEN up THEN 30.0 ELSE gain END / 100), 4) AS exit_price FROM (
    SELECT *, coalesce(max_gain_120m, 0.0) AS gain, coalesce(max_gain_120m, 0) >= 30 AS up,
        coalesce(min_loss_120m, 0) <= -12 AS down, coalesce(nullif(time_to_max_min, 0), 120.0) AS peak,
        CAST(floor(12500 / (close * 100)) AS BIGINT) AS num_contracts
    FROM {src} WHERE close > 0) WHERE num_contracts >= 1)"""


@add("J8_signal_overlap", "n_agree:l models:s signals:l total_unique_signals:l all_models_agree:l majority_agree:l", sql("""
    SELECT n_agree, models, count(*) AS signals, sum(count(*)) OVER () AS total_unique_signals,
        sum(CASE WHEN n_agree = (SELECT count(DISTINCT model) FROM trades) THEN count(*) ELSE 0 END) OVER () AS all_models_agree,
        sum(CASE WHEN n_agree >= 2 THEN count(*) ELSE 0 END) OVER () AS majority_agree
    FROM (SELECT ticker, entry_time, count(DISTINCT model) AS n_agree, string_agg(DISTINCT model, ',' ORDER BY model) AS models
          FROM trades WHERE proba >= 0.8 GROUP BY ticker, entry_time)
    GROUP BY n_agree, models""", "scored_models", trades=TRADES_SQL.format(src="scored_models")))
def overlap(spark, sf):
    return signal_overlap(trade_outcomes(views.scored_models(spark, sf)), 0.8)


@add("J9_attach_class_weight", "l_orderkey:l l_linenumber:l l_partkey:l target:l weight:d", sql("""
    SELECT * FROM scored s JOIN (SELECT target, (SELECT count(*) FROM scored) / (2.0::DOUBLE * count(*)) AS weight
        FROM scored GROUP BY target) USING (target)""", "scored"))
def class_weight_lookup(spark, sf):
    s = views.scored(spark, sf)
    return attach_class_weight(s, class_weights(s))


@add("J10_semi_anti", "kept:b ticker:s trade_date:s ts_ms:l", sql("""
    SELECT (trade_date, ticker) IN (SELECT (trade_date, ticker) FROM terms) AS kept, * FROM optbars""", "optbars", "terms"))
def semi_anti(spark, sf):
    b, c = views.option_bars(spark, sf), views.event_contracts(spark, sf)
    kept = b.join(c, ["trade_date", "ticker"], "left_semi").withColumn("kept", F.lit(True))
    return kept.unionByName(b.join(c, ["trade_date", "ticker"], "left_anti").withColumn("kept", F.lit(False)))


@add("J11_merge_mean", "ticker:s trade_date:s ts_ms:l close:d option_avg_price:d", sql("""
    SELECT b.*, m.option_avg_price FROM bars b JOIN (SELECT ticker, trade_date, ts_ms - ts_ms % 900000 AS ts_ms,
        avg(price) AS option_avg_price FROM ticks GROUP BY ALL) m USING (ticker, trade_date, ts_ms)""", "bars"))
def merged_mean(spark, sf):
    return resample_options(views.ticks(spark, sf), width_ms=views.BAR_MS, order="event_id")


@add("A5_opening_price", "trade_date:s opening_price:d", sql(
    "SELECT trade_date, arg_min(open, ts_ms) AS opening_price FROM und GROUP BY trade_date", "und"))
def opens(spark, sf):
    return opening_price(underlying_bars(spark, sf))
