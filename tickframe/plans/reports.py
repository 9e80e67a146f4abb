"""Multi-step reports composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, models, risk, scanners, trades
from ..operators.bars import opening_price
from ..operators.compare import best_threshold_per_model, comparison_report, model_threshold_results, signal_overlap
from ..operators.monitoring import ingest_stats
from ..operators.quality import RuleSet, split_valid, validate
from ..operators.selection import construct_contracts, targeted_selection
from ..operators.splits import chronological_split
from ..session import materialise
from ..sources.readers import normalise_bars
from ..functions.calendar import partition_date
from .jobs import write_days
from ..sources.tables import pending, record_done, table_exists, upsert_partitions


#: Columns that tell the rows of each output of a report apart.
REPORT_KEYS: dict[str, tuple[str, ...]] = {
    "by_type": ("option_type",), "hours": ("hour",), "sweep": ("scope", "period", "threshold"), "monthly": ("month",),
    "histogram": ("bin",), "stops": ("stop_level_pct",), "results": ("model", "threshold"), "report": ("model",),
    "best": ("model",), "overlap": ("n_agree", "models")}


def long_form(outputs: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] = REPORT_KEYS) -> DataFrame:
    """All outputs of a report as one table of (output, key, measure, number, label).

    Flags are 0 and 1, texts go to ``label``; keys are joined by ``|``, with two decimals where they
    are fractions.  Columns of nested types are left out.
    """
    def text(df: DataFrame, c: str):
        shown = F.format_string("%.2f", F.col(c)) if dict(df.dtypes)[c] == "double" else F.col(c).cast("string")
        return F.coalesce(shown, F.lit(""))

    def melted(name: str, df: DataFrame) -> DataFrame:
        by = [c for c in keys.get(name, ()) if c in df.columns]
        kinds = {c: k for c, k in df.dtypes if c not in by and not k.startswith(("map", "array", "struct"))}
        cells = [F.struct(F.lit(c).alias("measure"), (F.lit(None) if k == "string" else F.col(c)).cast("double").alias("number"),
                          (F.col(c) if k == "string" else F.lit(None)).cast("string").alias("label")) for c, k in kinds.items()]
        key = F.concat_ws("|", *[text(df, c) for c in by]) if by else F.lit("")
        return df.select(F.lit(name).alias("output"), key.alias("key"), F.inline(F.array(*cells)))

    return reduce(DataFrame.unionByName, [melted(n, df) for n, df in outputs.items()])


def scan_and_report(bars: DataFrame, forward: bool, path: str | None = None, **kw) -> dict[str, DataFrame]:
    """Events, summary (also by option type), hours and findings of a scan.

    With ``path`` the events replace their days in that table.
    """
    scan = scanners.scan_forward if forward else scanners.scan_backward
    found = scan(bars, **kw)
    events = write_days(found, path, ("ticker", "trigger_time_et"), "date") if path else materialise(found, "events")
    summary, hours = scanners.scan_summary(bars, events), scanners.trigger_hours(events)
    return {"events": events, "summary": summary, "hours": hours,
            "by_type": scanners.scan_summary(bars, events, ["option_type"]),
            "findings": scanners.scan_observations(summary, hours)}


def threshold_report(scored: DataFrame, thresholds: Sequence[float] = metrics.SWEEP_GRID) -> dict[str, DataFrame]:
    """Sweep by scope, monthly pivot and the two recommended thresholds."""
    sweep = materialise(metrics.threshold_sweep(scored, thresholds, periods="date"), "sweep")
    full = sweep.where(F.col("scope") == "full")
    return {"sweep": sweep, "monthly": metrics.monthly_pivot(sweep.where(F.col("scope") == "month")),
            "best_ev": metrics.optimal_threshold(full, "expected_value_pct", 0.90),
            "best_precision": metrics.optimal_threshold(full, "precision", 0.93)}


def error_report(trade_list: DataFrame, bins: int = 10) -> dict[str, DataFrame]:
    """Histogram, drawdown report, stop levels and expected value of a trade list."""
    fp = risk.false_positives(trade_list)
    return {"histogram": risk.equal_width_histogram(fp, "min_loss_120m", bins), "report": risk.risk_report(fp),
            "stops": risk.stop_loss_impact(fp), "expected_value": risk.trade_expected_value(trade_list)}


def full_comparison(scored: DataFrame, threshold: float = 0.80) -> dict[str, DataFrame]:
    """Per-model results, fixed-threshold table, best thresholds and overlap.

    ``scored`` is long: one row per (bar, model) with ``model`` and ``proba``.
    """
    outcomes = trades.trade_outcomes(scored)
    results = materialise(model_threshold_results(outcomes), "comparison")
    return {"results": results, "report": comparison_report(results, threshold),
            "best": best_threshold_per_model(results), "overlap": signal_overlap(outcomes, threshold)}


def select_contracts(bars: DataFrame, listed: DataFrame | None, underlying: str, n_calls: int, n_puts: int,
                     increment: float = 1.0, convention: str = "next_calendar_day") -> DataFrame:
    """Contracts around each day's open: matched against a listing, or constructed without one."""
    opens = opening_price(bars)
    if listed is None:
        return construct_contracts(opens, underlying, n_calls, n_puts, convention, increment)
    return targeted_selection(listed, opens, n_calls, n_puts, increment)


def backfill(raw: DataFrame, source: str, table: str, ledger: DataFrame | None, ledger_path: str,
             keys: Sequence[str], arrival: Sequence[str], rejects_path: str | None = None, days_at_once: int = 10,
             rules: RuleSet | None = None) -> DataFrame:
    """Normalise, validate and upsert the days not yet in the ledger, a few days at once.

    Returns the days done with their counts (fetched, valid, invalid, duplicates,
    written).  Days are recorded as soon as they are written, so a run that breaks off
    continues with the next ones; the days of a call are bounded by the calendar.
    Rejected rows go to ``rejects_path``, one folder per first day.  ``rules`` replace those of ``source``.
    """
    bars = normalise_bars(raw, source, "ticker" in raw.columns).withColumn("date", partition_date(F.col("timestamp")))
    days = bars.select(F.lit(source).alias("source"), "date").distinct()
    todo = pending(days, ledger) if ledger is not None else days
    todo = materialise(todo, "days")
    bars = materialise(bars.join(todo.select("date"), "date", "left_semi"), "backfill")
    dates = [r["date"] for r in todo.orderBy("date").collect()]
    for k in range(0, len(dates), days_at_once):
        part = bars.where(F.coalesce("date", F.lit("")).isin([d or "" for d in dates[k:k + days_at_once]]))
        good, bad = split_valid(part, rules or source)
        upsert_partitions(good.withColumnRenamed("date", "trade_date"), table, keys, arrival)
        if rejects_path:
            bad.write.mode("overwrite").parquet(f"{rejects_path}/from={dates[k]}")
        counts = ingest_stats(validate(part, rules or source), keys, ["date"])
        record_done(counts.select(F.lit(source).alias("source"), "*"), ledger_path)
    if not table_exists(raw.sparkSession, ledger_path):
        return todo
    return raw.sparkSession.read.parquet(ledger_path).join(todo, ["source", "date"], "left_semi")


def backtest(scored: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """Metrics and trades on the test split."""
    test = scored.where(F.col("split") == "test")
    return {"metrics": metrics.backtest_metrics(test, threshold), "trades": trades.build_trades(test, threshold)}


def find_threshold(scored: DataFrame, min_precision: float) -> DataFrame:
    """The precision-constrained threshold, searched on the validation split only."""
    split = scored if "split" in scored.columns else chronological_split(scored)
    return metrics.precision_threshold(split.where(F.col("split") == "val"), min_precision)


def train_and_score(features: DataFrame, cols: Sequence[str], keys: Sequence[str], **kw):
    """Fit on the balanced training split; returns (artifact, scored table with split)."""
    return models.train(features, cols, keys, **kw)
