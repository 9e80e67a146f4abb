"""Pricing, trades, models and schema drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import models, quality, risk, splits, trades
from ..sources import views
from . import pricing_sql as ps
from .aggregates import SPLIT_SQL, TOTALS_SQL, WALK_SQL, auc_sql
from .base import Catalog, sql
from .joins import TRADES_SQL
from .windows import drift_sql, sample_sql

CATALOG = Catalog()
add = CATALOG.add


def quotes(spark, sf):
    """Option bars as quotes: price, spot, strike, days and side."""
    b = views.option_bars(spark, sf)
    return b.select(
        "ticker", "trade_date", "ts_ms", (F.col("close") / 4).alias("p"), (F.lit(15.0) + F.pmod("volume", F.lit(40))).alias("s"),
        F.lit(25.0).alias("k"), (F.lit(1.0) + F.pmod("transactions", F.lit(5)) * 10).alias("days"),
        (F.col("ticker") == "purchase").alias("call"))


QUOTES_SQL = """SELECT ticker || ts_ms AS id, ticker, trade_date, ts_ms, close / 4 AS p, 15.0::DOUBLE + volume % 40 AS s,
    25.0::DOUBLE AS k, (1.0::DOUBLE + (transactions % 5) * 10) / 365 AS t,
    CASE WHEN ticker = 'purchase' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS w FROM optbars"""
_KEY = "ticker:s trade_date:s ts_ms:l"


def _iv(q):
    return pricing.implied_vol(F.col("p"), F.col("s"), F.col("k"), F.col("days"), F.col("call"))


@add("G1_implied_vol", f"{_KEY} iv:d", sql(
    f"SELECT * FROM q JOIN ({ps.IV_RESULT}) USING (id)", "optbars", q=QUOTES_SQL, chain_iv=ps.iv_chain("q")))
def implied_vol(spark, sf):
    q = quotes(spark, sf)
    return q.withColumn("iv", _iv(q))


@add("G1_round_trip", f"{_KEY} repriced:b", sql(
    "SELECT *, true AS repriced FROM q JOIN (SELECT id, inside FROM chain_iv WHERE step = 0) USING (id) WHERE inside", "optbars",
    q=QUOTES_SQL, chain_iv=ps.iv_chain("q")))
def round_trip(spark, sf):
    """Solved volatilities price back to the quote."""
    q = quotes(spark, sf)
    t = F.col("days") / pricing.YEAR_DAYS
    at = lambda v: pricing.bs_price(F.col("s"), F.col("k"), t, v, F.col("call"))
    inside = (at(F.lit(0.01)) <= F.col("p")) & (F.col("p") <= at(F.lit(5.0)))
    return (q.where(inside).withColumn("iv", _iv(q))
            .withColumn("repriced", F.abs(at(F.col("iv")) - F.col("p")) < 1e-6))


@add("G2_greeks", f"{_KEY} delta:d gamma:d theta:d vega:d rho:d", sql(
    f"SELECT * FROM ({ps.greeks('(SELECT *, 0.2::DOUBLE + volume_mod / 100.0::DOUBLE AS v FROM q)', 'v')})",
    "optbars", q=QUOTES_SQL.replace(" FROM optbars", ", volume % 30 AS volume_mod FROM optbars")))
def greeks(spark, sf):
    b = views.option_bars(spark, sf).select("ticker", "ts_ms", F.pmod("volume", F.lit(30)).alias("m"))
    q = quotes(spark, sf).join(b, ["ticker", "ts_ms"])
    g = pricing.greek_columns(F.col("s"), F.col("k"), F.col("days") / pricing.YEAR_DAYS,
                              F.lit(0.2) + F.col("m") / F.lit(100.0), F.col("call"))
    return q.select("ticker", "trade_date", "ts_ms", *[e.alias(n) for n, e in g.items()])


_ROW = "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l"


@add("T1_trade_outcomes",
     f"{_ROW} num_contracts:l actual_position_size:d exit_price:d4 exit_reason:s time_in_trade_minutes:d1 entry_time:s "
     "profit_loss_usd:d4 profit_loss_pct:d is_winner:b", sql(
         "SELECT * FROM trades WHERE proba >= 0.7", "scored", trades=TRADES_SQL.format(src="scored")))
def trade_outcomes(spark, sf):
    return trades.trade_outcomes(trades.signals_at(views.scored(spark, sf), 0.7))


_FACTORS = (("l_tax", 0.1), ("l_quantity", 0.5), ("l_discount", 0.4))


@add("T2_trigger_factors", f"{_ROW} position:l feature:s value:d4 importance:d4", sql("""
    SELECT *, f.pos AS position, f.feature AS feature, f.value AS value, f.importance AS importance FROM (
    SELECT *, unnest([{'pos': 0, 'feature': 'l_quantity', 'value': l_quantity, 'importance': 0.5},
        {'pos': 1, 'feature': 'l_discount', 'value': l_discount, 'importance': 0.4}]) AS f FROM scored WHERE proba >= 0.7)""", "scored"))
def trigger_factors(spark, sf):
    s = trades.trigger_factors(trades.signals_at(views.scored(spark, sf), 0.7), _FACTORS, 2)
    return s.select(*views.ROW_KEY, F.posexplode("trigger_factors").alias("position", "f")).select(
        *views.ROW_KEY, "position", "f.*")


@add("T3_build_trades",
     "timestamp:l date:s ticker:s close:d max_gain_120m:d min_loss_120m:d predicted_proba:d predicted_label:l actual_target:l is_true_positive:b",
     sql("""SELECT *, proba AS predicted_proba, 1 AS predicted_label, target AS actual_target, target = 1 AS is_true_positive
         FROM scored WHERE proba >= 0.7""", "scored"))
def build_trades(spark, sf):
    return trades.build_trades(views.scored(spark, sf), 0.7)


@add("T1_simulated_trades", f"{_ROW} trade_id:l confidence:d4 factors:s is_winner:b profit_loss_usd:d2", sql("""
    SELECT *, round(proba, 4) AS confidence, 'l_quantity=' || CAST(l_quantity AS BIGINT) AS factors FROM (
        SELECT * FROM trades JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (
            ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id FROM scored WHERE proba >= 0.7)
        USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE proba >= 0.7)""",
        "scored", trades=TRADES_SQL.format(src="scored")))
def simulated_trades(spark, sf):
    t = trades.simulated_trades(views.scored(spark, sf), 0.7, "timestamp", views.ROW_KEY, _FACTORS)
    first = F.get("trigger_factors", F.lit(0))
    return t.withColumn("factors", F.concat(first["feature"], F.lit("="), first["value"].cast("long").cast("string")))


#: One tree with one split over all different values, which SQL can work out from counts; larger models are for the tests.
ONE_SPLIT = {"maxIter": 1, "maxDepth": 1, "maxBins": 1024}


def modelling_rows(spark, sf):
    return views.scored(spark, sf).withColumnRenamed("proba", "signal").withColumnRenamed("proba_b", "signal_b")


MODEL_FEATURES = ("l_quantity", "l_discount", "l_tax", "signal", "signal_b")
_ROWS = "SELECT * EXCLUDE (proba, proba_b), proba AS signal, proba_b AS signal_b FROM scored"


def stump_sql(src: str, by: str = "", least: int = 1) -> str:
    """The best split of ``src`` for each ``by``: feature number, place and the mean of -1/1 labels on both sides."""
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    each = ", ".join(f"{{'f': {i}, 'v': CAST({c} AS DOUBLE)}}" for i, c in enumerate(MODEL_FEATURES))
    spread = lambda n, s: f"(({n} - {s} * {s} / ({n})) / ({n}))"
    gain = f"{spread('na', 'sa')} - nl / na * {spread('nl', 'sl')} - (na - nl) / na * {spread('(na - nl)', '(sa - sl)')}"
    return f"""SELECT {key}f, place, sl / nl AS low, (sa - sl) / (na - nl) AS high FROM (
        SELECT *, (v + nxt) / 2 AS place, {gain} AS gain FROM (
            SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, lead(v) OVER (PARTITION BY {key}f ORDER BY v) AS nxt,
                sum(n) OVER (PARTITION BY {key}f) AS na, sum(s) OVER (PARTITION BY {key}f) AS sa FROM (
                SELECT {key}u.f AS f, u.v AS v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(2 * target - 1) AS DOUBLE) AS s
                FROM (SELECT *, unnest([{each}]) AS u FROM {src}) GROUP BY ALL)
            WINDOW w AS (PARTITION BY {key}f ORDER BY v ROWS UNBOUNDED PRECEDING))
        WHERE nxt IS NOT NULL AND nl >= {least} AND na - nl >= {least})
        QUALIFY row_number() OVER ({part}ORDER BY gain DESC, f, place) = 1"""


def scored_sql(src: str, stump: str) -> str:
    """``src`` joined to its ``stump``, with the probability of class 1."""
    value = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in MODEL_FEATURES) + "][f + 1]"
    return f"SELECT *, 1 / (1 + exp(-2 * CASE WHEN {value} <= place THEN low ELSE high END)) AS proba FROM {src} {stump}"


_TRAINED = {"sp": SPLIT_SQL, "m": _ROWS, "parted": "SELECT * FROM m JOIN sp USING (date)", "train": "SELECT * FROM parted WHERE split = 'train'",
            "sampled": sample_sql("train"), "stump": stump_sql("sampled"), "judged": scored_sql("parted", ", stump")}


def confusion_sql(src: str, by: str, at: float) -> str:
    return f"""SELECT {by}, count(*) AS n_rows, count(*) FILTER (proba >= {at} AND target = 1) AS tp, count(*) FILTER (proba >= {at} AND target = 0) AS fp,
        count(*) FILTER (proba < {at} AND target = 1) AS fn, count(*) FILTER (proba < {at} AND target = 0) AS tn,
        avg(max_gain_120m) FILTER (proba >= {at}) AS gain_signals, avg(max_gain_120m) AS gain_all FROM {src} GROUP BY {by}"""


_RATES = """coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
    coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1"""


@add("M1_train", "split:s n_rows:l accuracy:d precision:d recall:d f1:d roc_auc:d", sql(f"""
    SELECT *, (tp + tn) / CAST(n_rows AS DOUBLE) AS accuracy, {_RATES} FROM ({confusion_sql("judged", "split", 0.5)})
    JOIN ({auc_sql("judged", "split")}) USING (split)""", "scored", **_TRAINED))
def train(spark, sf):
    _, scored = models.train(modelling_rows(spark, sf), MODEL_FEATURES, views.ROW_KEY, params=ONE_SPLIT)
    return models.evaluate(scored, 0.5)


@add("M2_score", f"{_ROW} proba:d", sql(f"SELECT * FROM ({scored_sql('m', ', stump')})", "scored", m=_ROWS,
                                        early="SELECT * FROM m WHERE date < '1999-01-01'", stump=stump_sql("early")))
def score(spark, sf):
    rows = modelling_rows(spark, sf)
    model = models.fit(rows.where(F.col("date") < "1999-01-01"), MODEL_FEATURES, ONE_SPLIT)
    return models.score(model, rows, MODEL_FEATURES)


_FOLD = ("split_index:l train_positives:l test_samples:l total_signals:l true_positives:l false_positives:l false_negatives:l true_negatives:l "
         "precision:d recall:d signal_rate:d tp_avg_gain_pct:d fp_avg_loss_pct:d expected_value_pct:d status:s total_trades:l winning_trades:l "
         "net_profit_after_fees_usd:d2")
_WALKED = {
    "m": _ROWS, "walk": WALK_SQL.replace("4 MONTH", "48 MONTH").replace("3 MONTH", "24 MONTH").replace("INTERVAL 1 MONTH)", "INTERVAL 24 MONTH)"),
    "ranged": "SELECT m.*, split_index FROM m JOIN walk ON date BETWEEN train_start AND train_end",
    "days": """SELECT split_index, date FROM (SELECT split_index, date, row_number() OVER (PARTITION BY split_index ORDER BY date) AS i,
        count(*) OVER (PARTITION BY split_index) AS n FROM (SELECT DISTINCT split_index, date FROM ranged)) WHERE n < 5 OR i <= floor(n * 0.80::DOUBLE)""",
    "fitted": "SELECT * FROM ranged JOIN days USING (split_index, date)", "sampled": sample_sql("fitted", "split_index"),
    "stump": stump_sql("sampled", "split_index"), "ahead": "SELECT m.*, split_index FROM m JOIN walk ON date BETWEEN test_start AND test_end",
    "tested": scored_sql("ahead", "JOIN stump USING (split_index)"),
    "trades": f"SELECT * FROM ({TRADES_SQL.format(src='tested')}) WHERE proba >= 0.5"}


@add("M3_walk_forward", _FOLD, sql(f"""
    SELECT *, tp + fp AS total_signals, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, {_RATES},
        n_rows AS test_samples, (tp + fp) / CAST(n_rows AS DOUBLE) AS signal_rate, g AS tp_avg_gain_pct, l AS fp_avg_loss_pct,
        CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) * g + (1 - tp / CAST(tp + fp AS DOUBLE)) * l ELSE 0.0 END AS expected_value_pct,
        CASE WHEN train_positives < 10 THEN 'INSUFFICIENT_DATA' ELSE 'SUCCESS' END AS status
    FROM ({confusion_sql("tested", "split_index", 0.5)})
    JOIN (SELECT split_index, coalesce(avg(max_gain_120m) FILTER (proba >= 0.5 AND target = 1), 0.0) AS g,
        coalesce(avg(min_loss_120m) FILTER (proba >= 0.5 AND target = 0), 0.0) AS l FROM tested GROUP BY 1) USING (split_index)
    JOIN (SELECT split_index, sum(target) AS train_positives FROM ranged GROUP BY 1) USING (split_index)
    LEFT JOIN ({TOTALS_SQL.format(trades="trades")}) USING (split_index)""", "scored", **_WALKED))
def walk_forward(spark, sf):
    rows = modelling_rows(spark, sf)
    windows = splits.walk_forward_splits(rows, 24, 24)
    return models.walk_forward(rows, MODEL_FEATURES, views.ROW_KEY, windows, 0.5, ONE_SPLIT)[0]


def _trial_sql(fold: int, least: int) -> str:
    """Precision of one fold's model on its test block, 0 with fewer than three signals."""
    start = f"n - (2 - {fold}) * (n // 3)"
    train, test = f"(SELECT * FROM placed WHERE i < {start})", f"(SELECT * FROM placed WHERE i >= {start} AND i < {start} + n // 3)"
    return f"""SELECT CASE WHEN tp + fp >= 3 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision FROM (
        {confusion_sql(f"({scored_sql(test, f', ({stump_sql(train, least=least)})')})", "1", _TUNED_AT)})"""


_TUNED_AT, _LEAST = 0.26, (1, 500)


@add("M4_tune", "params:s score:d", sql(" UNION ALL ".join(
    f"""SELECT '{{"maxBins": 1024, "maxDepth": 1, "maxIter": 1, "minInstancesPerNode": {least}}}' AS params, avg(precision) AS score
        FROM ({_trial_sql(0, least)} UNION ALL {_trial_sql(1, least)})""" for least in _LEAST), "scored", m=_ROWS,
    placed="SELECT *, row_number() OVER (ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER () AS n FROM m"))
def tune(spark, sf):
    grid = {**{k: (v,) for k, v in ONE_SPLIT.items()}, "minInstancesPerNode": _LEAST}
    return models.tune(modelling_rows(spark, sf), MODEL_FEATURES, grid, folds=2, threshold=_TUNED_AT, tie=views.ROW_KEY)


@add("M5_feature_importance", "feature:s importance:d share:d rank:l", sql(f"""
    SELECT *, importance AS share, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM (
    SELECT feature, CASE WHEN i = f THEN 1.0 ELSE 0.0 END AS importance
    FROM (SELECT unnest({list(MODEL_FEATURES)!r}) AS feature, unnest(range({len(MODEL_FEATURES)})) AS i), stump)""", "scored", m=_ROWS, stump=stump_sql("m")))
def feature_importance(spark, sf):
    model = models.fit(modelling_rows(spark, sf), MODEL_FEATURES, ONE_SPLIT)
    return risk.importance_table(models.feature_importance(spark, model, MODEL_FEATURES))


_PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_size": "bigint", "p_container": "string"}


@add("O1_schema_drift", "kind:s column:s expected:s actual:s n:l", drift_sql("part", _PART))
def schema_drift(spark, sf):
    p = views.table(spark, sf, "part")
    return quality.schema_drift(spark, p.schema, _PART).withColumn("n", p.agg(F.count(F.lit(1))).scalar())
