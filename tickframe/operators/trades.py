"""Trade outcomes from labelled, scored bars and reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import option_type
from ..functions.numeric import count_if
from .quantiles import exact_quantiles
from .ranking import global_position

# Sizing, exits and report bands.
POSITION_USD = 12_500.0
SHARES = 100
TARGET_PCT = 30.0
STOP_PCT = -12.0
TIME_LIMIT_MIN = 120.0
STOP_MINUTES = 30.0
FEE_USD = 4.0
ASSESSMENT = ((25_000, "EXCEEDS"), (20_000, "MEETS"), (15_000, "BELOW"))
EXIT_REASONS = ("Stop-loss (before target)", "Target hit", "Stop-loss", "Time limit (120 min)")


#: Columns that the outcome of a trade is taken from.
OUTCOME_COLUMNS = ("close", "max_gain_120m", "min_loss_120m", "time_to_max_min", "hour_et", "minute_et", "date", "ticker")


def trade_outcomes(signals: DataFrame, target_pct: float = TARGET_PCT, stop_pct: float = STOP_PCT,
                   position_usd: float = POSITION_USD, optimistic_exit: bool = True) -> DataFrame:
    """Size, exit, P&L and winner flag per signal row, as one projection.

    A bar that reaches both levels counts as stopped.  At the time limit the
    exit price uses the best gain of the window, which looks ahead;
    ``optimistic_exit=False`` exits at the entry price instead.
    """
    gain = F.coalesce(F.col("max_gain_120m"), F.lit(0.0))
    loss = F.coalesce(F.col("min_loss_120m"), F.lit(0.0))
    peak = F.coalesce(F.nullif(F.col("time_to_max_min"), F.lit(0.0)), F.lit(TIME_LIMIT_MIN))
    up, down = gain >= target_pct, loss <= stop_pct
    cost = F.col("close") * SHARES
    rest = gain if optimistic_exit else F.lit(0.0)
    exit_pct = F.when(down, F.lit(stop_pct)).when(up, F.lit(target_pct)).otherwise(rest)
    minutes = (F.when(up & down, F.greatest(F.lit(5.0), peak * 0.30))
               .when(up, F.greatest(F.lit(1.0), peak))
               .when(down, F.lit(STOP_MINUTES)).otherwise(F.lit(TIME_LIMIT_MIN)))
    reason = (F.when(up & down, EXIT_REASONS[0]).when(up, EXIT_REASONS[1])
              .when(down, EXIT_REASONS[2]).otherwise(EXIT_REASONS[3]))
    exit_cost = F.col("exit_price") * SHARES
    end = F.col("hour_et") * 60 + F.col("minute_et") + F.floor("_minutes")
    clock = lambda h, m: F.concat(F.col("date"), F.lit(" "), F.lpad(h.cast("string"), 2, "0"),
                                  F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(" ET"))
    return (
        signals.where((F.col("close") > 0) & ~F.isnan("close"))
        .withColumn("num_contracts", F.floor(position_usd / cost).cast("long"))
        .where(F.col("num_contracts") >= 1)
        .withColumn("actual_position_size", F.col("num_contracts") * cost)
        .withColumn("exit_price", F.round(F.col("close") * (1 + exit_pct / 100), 4))
        .withColumn("exit_reason", reason)
        .withColumn("_minutes", minutes)
        .withColumn("time_in_trade_minutes", F.round("_minutes", 1))
        .withColumn("entry_time", clock(F.col("hour_et"), F.col("minute_et")))
        .withColumn("exit_time", clock(F.floor(end / 60), F.pmod(end, F.lit(60))))
        .withColumn("profit_loss_usd", (exit_cost - cost) * F.col("num_contracts"))
        .withColumn("profit_loss_pct", (exit_cost - cost) / cost * 100)
        .withColumn("is_winner", F.col("profit_loss_usd") > 0)
        .drop("_minutes")
    )


def simulated_trades(scored: DataFrame, threshold: float, order: str, tie: Sequence[str], importances: Sequence[tuple[str, float]] = (),
                     score: str = "proba", **kw) -> DataFrame:
    """The trades of all signals with their number, confidence and trigger factors.

    Signals are numbered from 1 in (order, tie) order before those too dear for one contract are left out.
    """
    placed = global_position(signals_at(scored, threshold, score), order, tie, "_pos")
    numbered = placed.withColumn("trade_id", F.col("_pos") + 1).withColumn("confidence", F.round(F.col(score), 4))
    return trigger_factors(trade_outcomes(numbered.drop("_pos"), **kw), importances)


def trade_totals(trades: DataFrame, by: Sequence[str], fee_usd: float = FEE_USD) -> DataFrame:
    """Number, wins and net profit after fees of the trades of each group."""
    n, win = F.count(F.lit(1)), F.col("is_winner")
    return trades.groupBy(*by).agg(
        n.alias("total_trades"), count_if(win).alias("winning_trades"),
        (F.sum("profit_loss_usd") - n * fee_usd).alias("net_profit_after_fees_usd"))


def signals_at(scored: DataFrame, threshold: float, score: str = "proba") -> DataFrame:
    return scored.where(F.col(score) >= threshold)


def trigger_factors(signals: DataFrame, importances: Sequence[tuple[str, float]], top: int = 5) -> DataFrame:
    """The strongest model features with each row's value."""
    ranked = sorted(importances, key=lambda kv: -kv[1])[:top]
    items = [F.struct(F.lit(f).alias("feature"), F.round(F.col(f).cast("double"), 4).alias("value"),
                      F.lit(round(float(v), 4)).alias("importance")) for f, v in ranked]
    none = F.array().cast("array<struct<feature:string,value:double,importance:double>>")
    return signals.withColumn("trigger_factors", F.array(*items) if items else none)


# Outcome columns carried by a trade list.
TRADE_COLUMNS = ("timestamp", "date", "ticker", "close", "max_gain_120m", "min_loss_120m", "time_to_max_min")


def build_trades(scored: DataFrame, threshold: float, score: str = "proba") -> DataFrame:
    """Predicted-positive rows with their outcome."""
    keep = [c for c in TRADE_COLUMNS if c in scored.columns]
    return signals_at(scored, threshold, score).select(
        *keep, F.col(score).alias("predicted_proba"), F.lit(1).alias("predicted_label"),
        F.col("target").cast("int").alias("actual_target"), (F.col("target") == 1).alias("is_true_positive"))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def monthly_trade_report(trades: DataFrame, fee_usd: float = FEE_USD) -> DataFrame:
    """Counts, profit by side, return, time and exit statistics per calendar month."""
    t = trades.withColumn("month", F.substring("date", 1, 7))
    pnl, win = F.col("profit_loss_usd"), F.col("is_winner")
    n = F.count(F.lit(1))
    kind = option_type(F.col("ticker"), "X")
    side = lambda f, w: _zero(f(F.when(w, pnl)))
    gross_win, gross_loss = side(F.sum, win), side(F.sum, ~win)
    net = gross_win + gross_loss - n * fee_usd
    capital = F.sum("actual_position_size")
    report = t.groupBy("month").agg(
        n.alias("total_trades"), count_if(win).alias("winning_trades"), count_if(~win).alias("losing_trades"),
        (count_if(win) / n).alias("win_rate"),
        gross_win.alias("gross_profit_usd"), gross_loss.alias("gross_loss_usd"),
        (gross_win + gross_loss).alias("net_profit_usd"), (n * fee_usd).alias("total_fees_usd"),
        net.alias("net_profit_after_fees_usd"),
        side(F.avg, win).alias("avg_profit_per_win_usd"), side(F.max, win).alias("best_trade_usd"),
        side(F.avg, ~win).alias("avg_loss_per_loss_usd"), side(F.min, ~win).alias("worst_trade_usd"),
        F.avg("profit_loss_pct").alias("avg_return_per_trade_pct"),
        _zero(F.when(capital > 0, net / capital * 100)).alias("roi_pct"),
        F.avg("time_in_trade_minutes").alias("avg_time_minutes"),
        F.min("time_in_trade_minutes").alias("min_time_minutes"),
        F.max("time_in_trade_minutes").alias("max_time_minutes"),
        capital.alias("total_capital_deployed_usd"), F.sum("num_contracts").alias("total_contracts_traded"),
        count_if(kind == "C").alias("calls_traded"), count_if(kind == "P").alias("puts_traded"),
        F.map_filter(F.map_from_arrays(
            F.array(*[F.lit(r) for r in EXIT_REASONS]),
            F.array(*[count_if(F.col("exit_reason") == r) for r in EXIT_REASONS])),
            lambda k, v: v > 0).alias("exit_reasons"))
    # medians of the three measures in one pass over (month, measure)
    measures = t.select("month", F.inline(F.array(
        F.struct(F.when(win, "win").otherwise("loss").alias("m"), pnl.alias("v")),
        F.struct(F.lit("time").alias("m"), F.col("time_in_trade_minutes").alias("v")))))
    q = exact_quantiles(measures, ["month", "m"], "v", {"q": 0.5})
    pick = lambda m: _zero(F.max(F.when(F.col("m") == m, F.col("q"))))
    q = q.groupBy("month").agg(pick("win").alias("median_profit_per_win_usd"),
                               pick("loss").alias("median_loss_per_loss_usd"),
                               pick("time").alias("median_time_minutes"))
    return report.join(q, "month", "left")


def target_assessment(net: Column) -> Column:
    """Band of a month's net profit."""
    out = F
    for limit, label in ASSESSMENT:
        out = out.when(net >= limit, F.lit(label))
    return out.otherwise(F.lit("INSUFFICIENT"))
