"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import contracts as con
from ..functions.indicators import layered, plain_change, rolling_mean, series_window
from ..operators import quality, selection
from ..operators.balance import RESERVED, align_features, feature_columns
from ..operators.explain import interpret
from ..operators.metrics import apply_threshold
from ..operators.scanners import event_filter
from ..operators.trades import trade_outcomes
from ..plans.features import cross_asset
from ..sources import views
from .base import Catalog, sql

CATALOG = Catalog()
add = CATALOG.add

# Exchange wall-clock of the January event stream (UTC-5, no change of offset inside it).
ET_SQL = "(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR)"
HOLIDAYS = ("2024-01-15",)


def records(spark, sf):
    """Line items as bar records with gaps, zero volumes and foreign sources."""
    l = views.table(spark, sf, "lineitem")
    return l.select(
        *views.ROW_KEY,
        F.when(F.col("l_linenumber") != 3, F.unix_millis(F.col("l_shipdate").cast("timestamp"))
               * F.when(F.col("l_linenumber") == 2, -1).otherwise(1)).alias("timestamp"),
        F.col("l_extendedprice").alias("open"), (F.col("l_extendedprice") + 1).alias("high"),
        (F.col("l_extendedprice") - 1000).alias("low"), F.col("l_extendedprice").alias("close"),
        (F.col("l_quantity") - 1).cast("long").alias("volume"),
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice")).alias("vwap"),
        F.when(F.col("l_linestatus") == "O", "spy").otherwise("vix").alias("source"))


RECORDS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_linenumber <> 3 THEN epoch_ms(l_shipdate) * CASE WHEN l_linenumber = 2 THEN -1 ELSE 1 END END AS timestamp,
    l_extendedprice AS open, l_extendedprice + 1 AS high, l_extendedprice - 1000 AS low, l_extendedprice AS close,
    CAST(l_quantity - 1 AS BIGINT) AS volume, CASE WHEN l_tax <> 0 THEN l_extendedprice END AS vwap,
    CASE WHEN l_linestatus = 'O' THEN 'spy' ELSE 'vix' END AS source FROM lineitem"""


def _rules_sql(source: str) -> str:
    r = quality.RULES[source]
    checks = [f"CASE WHEN {c} IS NULL THEN 'missing:{c}' END" for c in sorted(r.required)]
    checks.append("CASE WHEN timestamp <= 0 THEN 'not_positive:timestamp' END")
    checks += [f"CASE WHEN {c} <= 0 THEN 'not_positive:{c}' END" for c in sorted(r.positive)]
    if r.source:
        checks.append(f"CASE WHEN source <> '{r.source}' THEN 'unexpected:source' END")
    return f"concat_ws(';', {', '.join(checks)})"


@add("P1_validate", "rules:s errors:s n:l keys:l", sql(
    "SELECT rules, errors, count(*) AS n, sum(l_orderkey) AS keys FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS rules, *, {_rules_sql(s)} AS errors FROM records"
                         for s in ("spy", "equity", "options", "vix")) + ") GROUP BY ALL", records=RECORDS_SQL))
def validate(spark, sf):
    r = records(spark, sf)
    parts = [quality.validate(r, s).withColumn("rules", F.lit(s)) for s in ("spy", "equity", "options", "vix")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.groupBy("rules", F.concat_ws(";", "errors").alias("errors")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@add("P2_strict_bar_ok", "l_orderkey:l l_linenumber:l l_partkey:l ok:b", sql(
    """SELECT *, coalesce(timestamp > 0 AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND vwap IS NOT NULL,
       false) AS ok FROM records""", records=RECORDS_SQL))
def strict_bar(spark, sf):
    required = ("timestamp", "open", "high", "low", "close", "vwap")
    return records(spark, sf).withColumn("ok", quality.strict_bar_ok(required))


_OPEN_SQL = f"""(isodow({ET_SQL}) < 6 AND CAST({ET_SQL} AS DATE) <> DATE '2024-01-15'
    AND CAST({ET_SQL} AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00')"""


@add("P3_market_open", "event_id:l is_open:b", sql(f"SELECT event_id, {_OPEN_SQL} AS is_open FROM ticks", "ticks"))
def market_open(spark, sf):
    return views.ticks(spark, sf).withColumn("is_open", cal.market_open(F.col("ts_ms"), HOLIDAYS))


@add("P4_seconds_to_open", "event_id:l seconds:l", sql(f"""
    SELECT event_id, CASE WHEN NOT {_OPEN_SQL} THEN (SELECT min(epoch_us(d) // 1000) FROM
        (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 14:30:00', TIMESTAMP '2024-02-09 14:30:00', INTERVAL 1 DAY)) AS d)
        WHERE isodow(d) < 6 AND CAST(d AS DATE) <> DATE '2024-01-15' AND epoch_us(d) // 1000 >= ts_ms
        AND (CAST(d AS DATE) > CAST({ET_SQL} AS DATE) OR CAST({ET_SQL} AS TIME) <= TIME '16:00:00')) - ts_ms
        END // 1000 AS seconds FROM ticks""", "ticks"))
def seconds_to_open(spark, sf):
    return views.ticks(spark, sf).withColumn("seconds", cal.seconds_to_open(F.col("ts_ms"), HOLIDAYS))


@add("P4_seconds_to_close", "event_id:l seconds:l", sql(f"""
    SELECT event_id, CASE WHEN {_OPEN_SQL} THEN
        (epoch_us(CAST(CAST({ET_SQL} AS DATE) AS TIMESTAMP) + INTERVAL 21 HOUR) // 1000 - ts_ms) // 1000 END AS seconds
    FROM ticks""", "ticks"))
def seconds_to_close(spark, sf):
    return views.ticks(spark, sf).withColumn("seconds", cal.seconds_to_close(F.col("ts_ms"), HOLIDAYS))


CLOCK_SQL = f"""SELECT *, hour({ET_SQL}) AS hour_et, minute({ET_SQL}) AS minute_et,
    hour({ET_SQL}) * 60 + minute({ET_SQL}) AS minute_of_day, hour({ET_SQL}) * 60 + minute({ET_SQL}) - 570 AS minutes_since_open"""


@add("P5_time_features",
     "event_id:l hour_et:l minute_et:l minute_of_day:l minutes_since_open:l is_morning:l pct_day_elapsed:d is_last_hour:l",
     sql("""SELECT *, CAST(minutes_since_open < 120 AS BIGINT) AS is_morning,
         greatest(0.0, least(1.0, minutes_since_open / 390.0::DOUBLE)) AS pct_day_elapsed,
         CAST(minutes_since_open >= 330 AS BIGINT) AS is_last_hour FROM c""", "ticks", c=f"{CLOCK_SQL} FROM ticks"))
def time_features(spark, sf):
    return cal.add_clock_features(views.ticks(spark, sf))


_SYMBOLS = "SELECT *, CASE WHEN l_linenumber = 6 THEN 'UND' || l_partkey ELSE ticker END AS symbol FROM scored"


@add("P6_parse_symbol", "l_orderkey:l l_linenumber:l l_partkey:l strike:d tte_days:d flag:s", sql("""
    SELECT *, CASE WHEN ok THEN CAST(regexp_extract(symbol, '(\\d{6})([CP])(\\d{8,15})$', 3) AS DOUBLE) / 1000 ELSE 400.0 END AS strike,
        CASE WHEN ok THEN greatest(CAST(date_diff('day', CAST(date AS DATE), CAST(strptime('20' ||
            regexp_extract(symbol, '(\\d{6})([CP])(\\d{8,15})$', 1), '%Y%m%d') AS DATE)) AS DOUBLE), 0.01) ELSE 1.0 END AS tte_days,
        CASE WHEN ok THEN lower(regexp_extract(symbol, '(\\d{6})([CP])(\\d{8,15})$', 2)) ELSE 'c' END AS flag
    FROM (SELECT *, regexp_matches(symbol, '(\\d{6})([CP])(\\d{8,15})$') AS ok FROM s)""", "scored", s=_SYMBOLS))
def parse_symbol(spark, sf):
    s = views.scored(spark, sf)
    symbol = F.when(F.col("l_linenumber") == 6, F.concat(F.lit("UND"), F.col("l_partkey").cast("string"))).otherwise(F.col("ticker"))
    return s.withColumn("_p", con.parse_symbol(symbol, F.col("date"))).select(*views.ROW_KEY, "_p.*")


@add("P7_build_symbol", "p_partkey:l symbol:s", sql("""
    SELECT p_partkey, 'O:UND' || strftime(CAST(expiration_date AS DATE), '%y%m%d') || upper(contract_type[1])
        || printf('%08d', CAST(round(strike_price * 1000) AS BIGINT)) AS symbol FROM contracts""", "contracts"))
def build_symbol(spark, sf):
    c = views.contracts(spark, sf)
    return c.select("p_partkey", con.build_symbol(F.lit("und"), F.to_date("expiration_date"), F.col("contract_type"),
                                                  F.col("strike_price")).alias("symbol"))


_LADDER_SQL = """SELECT *, CASE WHEN i <= 3 THEN 'call' ELSE 'put' END AS contract_type,
    CASE WHEN i <= 3 THEN i ELSE i - 3 END AS position,
    CASE WHEN i <= 3 THEN (floor(opening_price / 0.5 + 1e-9) + i) * 0.5
         ELSE (floor(opening_price / 0.5 + 1e-9) - (i - 3) + 1) * 0.5 END AS strike_price
    FROM opens, (SELECT unnest([1, 2, 3, 4, 5]) AS i)"""


@add("P8_strike_ladder", "p_partkey:l contract_type:s position:l strike_price:d", sql(
    _LADDER_SQL, opens="SELECT p_partkey, p_retailprice AS opening_price FROM part"))
def strike_ladder(spark, sf):
    opens = views.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("opening_price"))
    return selection.ladder_rows(opens, 3, 2, 0.5)


@add("P9_resolve_expiry", "o_orderkey:l next_day:s next_trading:s next_friday:s fixed:s third:s", """
    SELECT o_orderkey, d + 1 AS next_day,
        d + CAST(CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS next_trading,
        d + CAST(CASE WHEN isodow(d) < 5 THEN 5 - isodow(d) ELSE 12 - isodow(d) END AS INTEGER) AS next_friday,
        DATE '1999-06-18' AS fixed, d + 3 AS third
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def resolve_expiry(spark, sf):
    d = F.to_date("o_orderdate")
    return views.table(spark, sf, "orders").select(
        "o_orderkey", cal.resolve_expiry(d, "next_calendar_day").alias("next_day"),
        cal.resolve_expiry(d, "next_trading_day").alias("next_trading"),
        cal.resolve_expiry(d, "next_friday").alias("next_friday"),
        cal.resolve_expiry(d, "fixed", 1, "1999-06-18").alias("fixed"),
        cal.resolve_expiry(d, "next_calendar_day", 3).alias("third"))


OPENS_SQL = "SELECT trade_date, arg_min(open, ts_ms) AS opening_price FROM bars GROUP BY trade_date"


def daily_opens(spark, sf):
    """A day's opening level: the mean listed strike plus the day of month."""
    c = views.contracts(spark, sf).groupBy("expiration_date").agg(F.avg("strike_price").alias("_k"))
    return c.select(F.date_format(F.date_sub(F.to_date("expiration_date"), 1), "yyyy-MM-dd").alias("trade_date"),
                    F.round("_k", 1).alias("opening_price"))


DAILY_OPENS_SQL = """SELECT strftime(CAST(expiration_date AS DATE) - 1, '%Y-%m-%d') AS trade_date,
    round(avg(strike_price), 1) AS opening_price FROM contracts GROUP BY expiration_date"""


@add("P10_construct_contracts", "trade_date:s contract_type:s position:l strike_price:d expiration_date:s ticker:s", sql(f"""
    SELECT *, 'O:UND' || strftime(expiration_date, '%y%m%d') || upper(contract_type[1])
        || printf('%08d', CAST(round(strike_price * 1000) AS BIGINT)) AS ticker FROM (
    SELECT *, CAST(trade_date AS DATE) + CASE isodow(CAST(trade_date AS DATE)) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END
        AS expiration_date FROM ({_LADDER_SQL}))""", "contracts", opens=DAILY_OPENS_SQL))
def construct_contracts(spark, sf):
    return selection.construct_contracts(daily_opens(spark, sf), "und", 3, 2, "next_trading_day", 0.5)


@add("P11_discover_in_range", "trade_date:s ticker:s strike_price:d contract_type:s", sql("""
    SELECT o.trade_date, c.* FROM contracts c JOIN opens o
        ON CAST(c.expiration_date AS DATE) = CAST(o.trade_date AS DATE) + 1
    WHERE strike_price BETWEEN round(opening_price * 0.97, 2) AND round(opening_price * 1.03, 2)""", "contracts", opens=DAILY_OPENS_SQL))
def discover_in_range(spark, sf):
    return selection.discover_in_range(views.contracts(spark, sf), daily_opens(spark, sf), 0.03, 1)


@add("P12_option_type", "l_orderkey:l l_linenumber:l l_partkey:l kind:s", sql(
    """SELECT *, CASE WHEN l_linenumber = 6 THEN 'X' WHEN l_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS kind FROM scored""", "scored"))
def option_type(spark, sf):
    symbol = F.when(F.col("l_linenumber") == 6, F.lit("UND")).otherwise(F.col("ticker"))
    return views.scored(spark, sf).withColumn("kind", con.option_type(symbol, "X"))


@add("P13_moneyness", "p_partkey:l moneyness:d log_moneyness:d is_0dte:l contract_flag:l", """
    SELECT p_partkey, spot / strike AS moneyness, CASE WHEN spot > 0 THEN ln(spot / strike) END AS log_moneyness,
        CAST(p_size < 2 AS BIGINT) AS is_0dte, CAST(p_partkey % 2 = 0 AS BIGINT) AS contract_flag
    FROM (SELECT *, p_size * 20.0::DOUBLE - 20 AS spot, nullif(p_retailprice - 900, 0) AS strike FROM part)""")
def moneyness(spark, sf):
    p = views.table(spark, sf, "part")
    spot, strike = F.col("p_size") * 20.0 - 20, F.col("p_retailprice") - 900
    flag = F.when(F.pmod("p_partkey", F.lit(2)) == 0, "c").otherwise("p")
    return p.select("p_partkey", con.moneyness(spot, strike).alias("moneyness"),
                    con.log_moneyness(spot, strike).alias("log_moneyness"),
                    con.is_0dte(F.col("p_size") - 1).alias("is_0dte"), con.call_flag(flag).alias("contract_flag"))


@add("P14_tte_days", "event_id:l tte:d12", sql("""
    SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (epoch_ms(CAST(CAST(trade_date AS DATE) + CAST(volume % 3 AS INTEGER) AS TIMESTAMP)) - ts_ms)
        / 86400000.0::DOUBLE END AS tte FROM ticks""", "ticks"))
def tte_days(spark, sf):
    t = views.ticks(spark, sf)
    day = F.date_format(F.date_add(F.to_date("trade_date"), F.pmod("volume", F.lit(3)).cast("int")), "yyyy-MM-dd")
    expiry = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("n/a")).otherwise(day)
    return t.select("event_id", cal.tte_days(F.col("ts_ms"), expiry).alias("tte"))


@add("P15_feature_columns", "feature:s non_null:l", sql("""
    SELECT 'l_discount' AS feature, count(l_discount) AS non_null FROM scored
    UNION ALL SELECT 'l_quantity', count(l_quantity) FROM scored UNION ALL SELECT 'l_tax', count(l_tax) FROM scored""", "scored"))
def feature_list(spark, sf):
    s = views.scored(spark, sf).select("timestamp", "date", "ticker", "close", "target", "max_gain_120m",
                                       "min_loss_120m", "time_to_max_min", "l_tax", "l_quantity", "l_discount")
    cols = feature_columns(s, RESERVED)
    counted = s.agg(*[F.count(c).alias(c) for c in cols])
    return counted.unpivot([], cols, "feature", "non_null")


@add("P16_align_features", "l_orderkey:l l_linenumber:l l_partkey:l l_tax:d time_to_max_min:d absent:d", sql(
    "SELECT *, coalesce(time_to_max_min, 0.0) AS time_to_max_min_, 0.0 AS absent FROM scored", "scored").replace(
        "SELECT *, coalesce(time_to_max_min, 0.0) AS time_to_max_min_",
        "SELECT * REPLACE (coalesce(time_to_max_min, 0.0) AS time_to_max_min)"))
def aligned(spark, sf):
    return align_features(views.scored(spark, sf), ["l_tax", "time_to_max_min", "absent"])


@add("P17_apply_threshold", "l_orderkey:l l_linenumber:l l_partkey:l predicted:l", sql(
    "SELECT *, CAST(proba >= 0.7 AS BIGINT) AS predicted FROM scored", "scored"))
def threshold(spark, sf):
    return apply_threshold(views.scored(spark, sf), 0.7)


IMPACTS = ("opt_rsi_14", "moneyness", "implied_volatility", "l_tax")


def _features():
    """feature: (value, signed contribution)"""
    return dict(zip(IMPACTS, ((F.col("l_quantity") * 2, F.col("proba") - 0.5), (F.col("l_extendedprice") / 50_000, F.col("proba_b") - 0.5),
                              (F.col("l_discount") * 5, F.col("proba_c") - 0.5), (F.col("l_tax"), F.col("l_tax") - 0.04))))


def contributions(spark, sf):
    """Long form of the features of a row with a signed contribution."""
    item = lambda f, v, i: F.struct(F.lit(f).alias("feature"), v.alias("value"), i.alias("impact"))
    each = F.inline(F.array(*[item(f, v, i) for f, (v, i) in _features().items()]))
    return views.scored(spark, sf).select(*views.ROW_KEY, "proba", each)


def wide_impacts(spark, sf):
    """The contributions of a row as columns named by feature."""
    return views.scored(spark, sf).select(*views.ROW_KEY, "proba", *[i.alias(f) for f, (_, i) in _features().items()])


CONTRIBUTIONS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, proba, 'opt_rsi_14' AS feature,
        l_quantity * 2 AS value, proba - 0.5 AS impact FROM scored
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, proba, 'moneyness', l_extendedprice / 50000, proba_b - 0.5 FROM scored
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, proba, 'implied_volatility', l_discount * 5, proba_c - 0.5 FROM scored
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, proba, 'l_tax', l_tax, l_tax - 0.04 FROM scored"""


@add("P18_interpret_feature", "feature:s meaning:s n:l keys:l", sql("""
    SELECT feature, CASE feature
        WHEN 'opt_rsi_14' THEN CASE WHEN value >= 70 THEN 'overbought' WHEN value <= 30 THEN 'oversold' ELSE 'neutral' END
        WHEN 'moneyness' THEN CASE WHEN value < 0.97 THEN 'deep ITM' WHEN value < 0.995 THEN 'ITM'
            WHEN value <= 1.005 THEN 'ATM' WHEN value <= 1.03 THEN 'OTM' ELSE 'deep OTM' END
        WHEN 'implied_volatility' THEN CASE WHEN value > 0.40 THEN 'high' WHEN value < 0.15 THEN 'low' ELSE 'moderate' END
        ELSE feature || ' = ' || CASE WHEN value = 0 THEN '0.000' ELSE printf('%.5f', value) END END AS meaning,
        count(*) AS n, sum(l_orderkey) AS keys FROM c GROUP BY ALL""",
    "scored", c=CONTRIBUTIONS_SQL))
def interpret_features(spark, sf):
    return interpret(contributions(spark, sf)).groupBy("feature", "meaning").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@add("P19_cross_asset", "ticker:s trade_date:s ts_ms:l opt_vs_u_return_1m:d opt_vwap_dist_pct:d u_vol_regime:d opt_vol_pct_cumday:d transactions_ratio:d", sql("""
    SELECT b.ticker, b.trade_date, b.ts_ms, b.r - u.r AS opt_vs_u_return_1m, (b.close - b.vwap) / nullif(b.vwap, 0) * 100 AS opt_vwap_dist_pct,
        u.volume / nullif(u.ma, 0) AS u_vol_regime, b.share AS opt_vol_pct_cumday,
        b.transactions / nullif(CAST(u.transactions AS DOUBLE), 0) AS transactions_ratio
    FROM (SELECT *, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS r,
            sum(volume) OVER w / CAST(sum(volume) OVER (PARTITION BY ticker, trade_date) AS DOUBLE) AS share
          FROM bars WINDOW w AS (PARTITION BY ticker, trade_date ORDER BY ts_ms)) b
    LEFT JOIN (SELECT *, avg(volume) OVER (PARTITION BY trade_date ORDER BY ts_ms ROWS 29 PRECEDING) AS ma,
            (close - lag(close) OVER v) / nullif(lag(close) OVER v, 0) * 100 AS r FROM und WINDOW v AS (PARTITION BY trade_date ORDER BY ts_ms)) u
        ON b.trade_date = u.trade_date AND b.ts_ms = u.ts_ms""", "bars", "und"))
def cross_asset_ratios(spark, sf):
    b = views.bars(spark, sf).withColumn("opt_return_1m", plain_change("close", 1, series_window()))
    u = layered(b.where(F.col("ticker") == views.UNDERLYING), rolling_mean("volume", 30, "u_vol_ma30", series_window(("trade_date",))))
    u = u.select("trade_date", "ts_ms", "u_vol_ma30", F.col("opt_return_1m").alias("u_return_1m"),
                 *[F.col(c).alias(f"u_{c}") for c in ("volume", "transactions")])
    return layered(b.join(u, ["trade_date", "ts_ms"], "left"), [cross_asset("u")])


@add("P20_event_filters", "date:s ticker:s n:l", sql("""
    SELECT date, ticker, count(*) AS n FROM scored WHERE proba >= 0.5 AND close > 0 AND floor(12500 / (close * 100)) >= 1
        AND date >= '1996-01-01' AND date <= '2000-12-31' AND l_partkey % 2 = 0
        AND coalesce(max_gain_120m, 0) < 30 AND coalesce(min_loss_120m, 0) > -12
        AND round(close * (1 + coalesce(max_gain_120m, 0) / 100), 4) > close
    GROUP BY ALL""", "scored"))
def report_filters(spark, sf):
    s = views.scored(spark, sf).where(F.col("proba") >= 0.5)
    kept = event_filter(trade_outcomes(s), "1996-01-01", "2000-12-31", ["C"], True, ["Time limit (120 min)"])
    return kept.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("n"))
