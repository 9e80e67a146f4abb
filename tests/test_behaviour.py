"""Small hand-computed cases of operator semantics."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import schemas
from tickframe.functions import calendar as cal
from tickframe.functions import contracts as con
from tickframe.functions import indicators as ind
from tickframe.operators import balance, compare, explain, labels, monitoring, quality, risk, scanners, selection, splits, trades
from tickframe.operators.bars import resample_ohlcv
from tickframe.operators.flatten import flatten_with_fallback
from tickframe.session import scratch_path, shared_root
from tickframe.sources import readers, tables

DAY0 = 1_709_562_600_000  # Monday 2024-03-04 09:30 in New York


def _bars(spark, closes, ticker="O:UND240304C00100000", step=60_000):
    rows = [("2024-03-04", ticker, DAY0 + i * step, c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "trade_date string, ticker string, ts_ms long, close double")


# ── scans ────────────────────────────────────────────────────────────────

def test_flat_and_small_moves_give_no_event(spark):
    assert scanners.scan_backward(_bars(spark, [10.0] * 20), window=10).count() == 0
    assert scanners.scan_backward(_bars(spark, [10.0] * 5 + [11.5] * 5), window=10).count() == 0


def test_backward_event_fields(spark):
    r = scanners.scan_backward(_bars(spark, [10.0, 10.0, 12.5, 12.0, 11.5, 10.5, 10.0]), window=10).first()
    assert (r["reference_time_et"], r["trigger_time_et"]) == ("09:30:00", "09:32:00")
    assert (r["gain_pct"], r["above_20pct_duration_min"], r["above_10pct_duration_min"]) == (25.0, 2, 3)


def test_backward_needs_a_fresh_low(spark):
    back_to_low = [10.0, 12.5, 10.0, 12.5, 12.5]  # the bar that breaks the run is used up
    assert scanners.scan_backward(_bars(spark, back_to_low), window=10).count() == 1
    fresh = [10.0, 12.5, 10.5, 8.0, 9.8, 9.8]
    assert scanners.scan_backward(_bars(spark, fresh), window=10).count() == 2


def test_forward_event_consumes_its_run(spark):
    got = scanners.scan_forward(_bars(spark, [10.0, 10.5, 12.0, 12.5, 11.2, 10.9, 10.0]), window=10).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["entry_time_et"], r["minutes_to_trigger"], r["above_20pct_duration_min"], r["above_10pct_duration_min"]) == (
        "09:30:00", 2, 2, 3)


def test_null_closes_are_ignored_by_scans(spark):
    assert scanners.scan_backward(_bars(spark, [10.0, None, 10.0, None]), window=10).count() == 0


def test_summary_counts_event_free_days(spark):
    bars = _bars(spark, [10.0, 12.5, 12.5]).unionByName(_bars(spark, [1.0] * 5, "O:UND240304P00100000"))
    events = scanners.scan_backward(bars, window=10)
    r = scanners.scan_summary(bars, events).first()
    assert (r["contract_days"], r["total_bars"], r["total_events"], r["min_events"], r["median_events"]) == (2, 8, 1, 0, 0.5)
    assert r["positive_minute_rate"] == pytest.approx(25.0)
    kinds = {x["option_type"]: x["contract_days"] for x in scanners.scan_summary(bars, events, ["option_type"]).collect()}
    assert kinds == {"C": 1, "P": 1}
    none = scanners.scan_observations(scanners.scan_summary(bars, events.limit(0)), scanners.trigger_hours(events.limit(0))).first()
    assert none["rate_finding"] == "none" and none["peak_finding"] is None


# ── labels ───────────────────────────────────────────────────────────────

def test_label_window_is_inclusive_and_first_maximum_wins(spark):
    closes = [10.0, 13.0, 9.0, 13.0]
    rows = labels.forward_labels(_bars(spark, closes), horizon=3).orderBy("ts_ms").collect()
    assert (rows[0]["target"], rows[0]["max_gain_120m"], rows[0]["time_to_max_min"]) == (1, 30.0, 1.0)
    assert rows[0]["min_loss_120m"] == pytest.approx(-10.0)
    assert rows[3]["max_gain_120m"] is None and rows[3]["target"] == 0
    short = labels.forward_labels(_bars(spark, [10.0, 10.0, 10.0, 13.0]), horizon=2).orderBy("ts_ms").first()
    assert short["target"] == 0


def test_labels_skip_bad_entries_and_keep_tickers_apart(spark):
    df = _bars(spark, [0.0, None, 10.0]).unionByName(_bars(spark, [10.0, 99.0], "other"))
    rows = {(r["ticker"], r["ts_ms"]): r for r in labels.forward_labels(df).collect()}
    mine = [v for (t, _), v in sorted(rows.items()) if t != "other"]
    assert [r["max_gain_120m"] for r in mine] == [None, None, None] and {r["target"] for r in mine} == {0}


def test_future_vector_and_coverage(spark):
    df = labels.future_price_vector(_bars(spark, [1.0, 2.0, 3.0]), 3)
    first = df.orderBy("ts_ms").first()["target_future_prices"]
    assert first == [2.0, 3.0, None]
    assert labels.target_coverage_filter(df, 50.0).count() == 1


# ── contracts and calendar ───────────────────────────────────────────────

def test_symbols(spark):
    rows = [("O:QQX260116C00431500", "2026-01-13"), ("o_qqx260116p00432250", "2026-01-17"), ("junk", "2026-01-13"),
            ("O:QQX269916C00431500", "2026-01-13"), (None, "2026-01-13")]
    df = spark.createDataFrame(rows, "t string, d string").withColumn("p", con.parse_symbol(F.col("t"), F.col("d")))
    got = [tuple(r["p"]) for r in df.collect()]
    assert got == [(431.5, 3.0, "c"), (432.25, 0.01, "p")] + [(400.0, 1.0, "c")] * 3
    built = spark.createDataFrame([("qqx", "2026-01-16", "call", 431.5), ("qqx", "2026-01-16", "put", 123456.5), ("qqx", "2026-01-16", "put", None)],
                                  "u string, e string, k string, s double")
    symbols = [r[0] for r in built.select(con.build_symbol(F.col("u"), F.to_date("e"), F.col("k"), F.col("s"))).collect()]
    assert symbols == ["O:QQX260116C00431500", "O:QQX260116P123456500", None]
    back = spark.createDataFrame([(symbols[1], "2026-01-13")], "t string, d string").select(con.parse_symbol(F.col("t"), F.col("d")).alias("p"))
    assert back.first()["p"]["strike"] == 123456.5


def test_ladder_puts_include_the_open(spark):
    df = spark.createDataFrame([(600.25,), (600.0,)], "opening_price double")
    got = {(r["opening_price"], r["contract_type"], r["position"]): r["strike_price"] for r in selection.ladder_rows(df, 2, 2, 0.5).collect()}
    assert [got[600.25, "call", 1], got[600.25, "call", 2], got[600.25, "put", 1], got[600.25, "put", 2]] == [600.5, 601.0, 600.0, 599.5]
    assert (got[600.0, "call", 1], got[600.0, "put", 1]) == (600.5, 600.0)


def test_session_hours_follow_daylight_saving(spark):
    stamps = {"2024-07-01T13:30:00": True, "2024-07-01T13:29:59.999": False, "2024-07-01T20:00:00": True,
              "2024-07-01T20:00:00.001": False, "2024-01-02T14:30:00": True, "2024-01-02T13:30:00": False,
              "2024-07-04T15:00:00": False, "2024-07-06T15:00:00": False}
    ms = [int(pd.Timestamp(s).value // 1_000_000) for s in stamps]
    df = spark.createDataFrame([(m,) for m in ms], "ts_ms long")
    got = df.select("ts_ms", cal.market_open(F.col("ts_ms"), ["2024-07-04"]).alias("o"),
                    cal.seconds_to_open(F.col("ts_ms"), ["2024-07-04"]).alias("w"),
                    cal.seconds_to_close(F.col("ts_ms"), ["2024-07-04"]).alias("c")).collect()
    assert {r["ts_ms"]: r["o"] for r in got} == dict(zip(ms, stamps.values()))
    waits = {r["ts_ms"]: (r["w"], r["c"]) for r in got}
    assert waits[ms[0]] == (None, 6.5 * 3600) and waits[ms[6]] == (22.5 * 3600, None) and waits[ms[7]] == (46.5 * 3600, None)


def test_expiry_conventions(spark):
    df = spark.createDataFrame([("2025-03-06",), ("2025-03-07",), ("2025-03-08",)], "d string")
    day = F.to_date("d")
    got = df.select(*[cal.resolve_expiry(day, c).cast("string") for c in ("next_calendar_day", "next_trading_day", "next_friday")]).collect()
    assert [tuple(r) for r in got] == [("2025-03-07", "2025-03-07", "2025-03-07"), ("2025-03-08", "2025-03-10", "2025-03-14"),
                                       ("2025-03-09", "2025-03-10", "2025-03-14")]
    with pytest.raises(ValueError):
        cal.resolve_expiry(day, "someday")


def test_targeted_selection_takes_first_expiry_in_range(spark):
    listed = spark.createDataFrame(
        [("a", 101.0, "2024-03-06", "CALL"), ("b", 102.0, "2024-03-06", "call"), ("c", 100.0, "2024-03-06", "put"),
         ("d", 99.0, "2024-03-06", "put"), ("e", 500.0, "2024-03-05", "call"), ("f", 101.0, "2024-03-07", "call")],
        "ticker string, strike_price double, expiration_date string, contract_type string")
    opens = spark.createDataFrame([("2024-03-04", 100.4)], "trade_date string, opening_price double")
    got = selection.targeted_selection(listed, opens, 2, 2).orderBy("contract_type", "rank").collect()
    assert [r["ticker"] for r in got] == ["a", "b", "c", "d"]
    close = listed.withColumn("strike_price", F.col("strike_price") + 0.009)
    assert selection.targeted_selection(close, opens, 2, 2).count() == 4
    far = listed.withColumn("strike_price", F.col("strike_price") + 0.011)
    assert selection.targeted_selection(far, opens, 2, 2).count() == 0


# ── quality, bars, flattening ────────────────────────────────────────────

def test_validation_errors_in_order(spark):
    df = spark.createDataFrame([(0, None, -1.0, 5.0, 5.0, 0, 5.0, "vix")],
                               "timestamp long, open double, high double, low double, close double, volume long, vwap double, source string")
    assert quality.validate(df, "spy").first()["errors"] == [
        "missing:open", "not_positive:timestamp", "not_positive:high", "not_positive:volume", "unexpected:source"]
    news = spark.createDataFrame([("2024-03-04", "t", "news")], "timestamp string, title string, source string")
    assert quality.validate(news, "news").first()["errors"] == []
    assert quality.validate(news.drop("title"), "news").first()["errors"] == ["missing:title"]


def test_schema_drift_toggles_and_first_run(spark):
    now = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    base = {"a": "int", "c": "string"}
    kinds = lambda **kw: sorted(r["kind"] for r in quality.schema_drift(spark, now, base, **kw).collect())
    assert kinds() == ["missing_column", "new_column", "type_change"]
    assert kinds(new_columns=False) == ["missing_column", "type_change"]
    assert quality.schema_drift(spark, now, None).count() == 0


def test_bars_skip_nulls_and_zero_volume(spark):
    rows = [("d", DAY0 + 1, None, 5.0, 4.0, 5.0, 0, 5.0, 1), ("d", DAY0 + 2, 4.5, 6.0, 3.0, None, 0, 5.0, 1)]
    df = spark.createDataFrame(rows, "trade_date string, ts_ms long, open double, high double, low double, close double, volume long, vwap double, transactions long")
    r = resample_ohlcv(df).first()
    assert (r["ts_ms"], r["open"], r["high"], r["low"], r["close"], r["volume"], r["vwap"]) == (DAY0, 4.5, 6.0, 3.0, 5.0, 0, None)


def test_flatten_fallback_only_for_days_without_options(spark):
    und = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "trade_date string, ts_ms long")
    opt = spark.createDataFrame([("d1", 1, "x", "call", 1.0, 2.0, 3.0)],
                                "trade_date string, ts_ms long, ticker string, contract_type string, strike_price double, time_to_expiry_days double, option_avg_price double")
    got = {(r["trade_date"], r["ts_ms"], r["ticker"]) for r in flatten_with_fallback(und, opt).collect()}
    assert got == {("d1", 1, "x"), ("d2", 1, None)}
    assert flatten_with_fallback(und, opt.limit(0)).count() == 3


# ── splits, balance, trades, comparison ──────────────────────────────────

@pytest.mark.parametrize("n,want", [(3, (1, 1, 1)), (4, (2, 1, 1)), (10, (7, 1, 2)), (20, (14, 3, 3)), (2, (1, 0, 1))])
def test_date_split_sizes(spark, n, want):
    df = splits.date_splits(spark, [f"2024-01-{i + 1:02d}" for i in range(n)])
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == want


def test_splits_are_ordered(spark):
    df = splits.date_splits(spark, [f"2024-01-{i + 1:02d}" for i in range(20)])
    span = {r["split"]: (r["a"], r["b"]) for r in df.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert span["train"][1] < span["val"][0] and span["val"][1] < span["test"][0]
    with pytest.raises(ValueError):
        splits.split_dates(df, 0.9, 0.1)


def test_walk_forward_drops_partial_month(spark):
    dates = spark.createDataFrame([("2024-01-10",), ("2024-06-15",)], "date string")
    got = splits.walk_forward_splits(dates).orderBy("split_index").collect()
    assert [(r["train_start"], r["train_end"], r["test_start"], r["test_end"]) for r in got] == [
        ("2024-01-01", "2024-03-31", "2024-04-01", "2024-04-30"), ("2024-02-01", "2024-04-30", "2024-05-01", "2024-05-31")]


def test_sequences_carry_the_next_rows_label(spark):
    df = spark.createDataFrame([("a", i, float(i), i % 2) for i in range(5)], "k string, ts_ms long, x double, target int")
    got = splits.sliding_sequences(df, ["x"], 3, ["k"], "ts_ms").orderBy("ts_ms").collect()
    assert [(r["sequence"], r["label"]) for r in got] == [([[0.0], [1.0], [2.0]], 1), ([[1.0], [2.0], [3.0]], 0)]
    assert splits.sliding_sequences(df, ["x"], 5, ["k"], "ts_ms").count() == 0


def test_imbalance_without_positives_is_infinite(spark):
    r = balance.imbalance_summary(spark.createDataFrame([(0,), (0,)], "target int")).first()
    assert r["imbalance_ratio"] == float("inf") and r["positive_rate"] == 0.0
    with pytest.raises(ValueError):
        balance.balance(spark.range(1), "other", ["id"])


def _signal(spark, **kw):
    row = {"close": 2.0, "max_gain_120m": 10.0, "min_loss_120m": -5.0, "time_to_max_min": 40.0, "date": "2024-03-04",
           "hour_et": 10, "minute_et": 50, "ticker": "O:UND240304C00100000", **kw}
    schema = ("close double, max_gain_120m double, min_loss_120m double, time_to_max_min double, date string, hour_et long, "
              "minute_et long, ticker string")
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize("kw,want", [
    ({"max_gain_120m": 40.0}, ("Target hit", 2.6, 40.0, "2024-03-04 11:30 ET")),
    ({"max_gain_120m": 40.0, "min_loss_120m": -20.0}, ("Stop-loss (before target)", 1.76, 12.0, "2024-03-04 11:02 ET")),
    ({"min_loss_120m": -20.0}, ("Stop-loss", 1.76, 30.0, "2024-03-04 11:20 ET")),
    ({}, ("Time limit (120 min)", 2.2, 120.0, "2024-03-04 12:50 ET")),
    ({"max_gain_120m": None, "min_loss_120m": None, "time_to_max_min": None}, ("Time limit (120 min)", 2.0, 120.0, "2024-03-04 12:50 ET")),
    ({"max_gain_120m": 40.0, "time_to_max_min": 0.0}, ("Target hit", 2.6, 120.0, "2024-03-04 12:50 ET")),
])
def test_trade_exits(spark, kw, want):
    r = trades.trade_outcomes(_signal(spark, **kw)).first()
    assert (r["exit_reason"], r["exit_price"], r["time_in_trade_minutes"], r["exit_time"]) == want
    assert r["num_contracts"] == 62 and r["is_winner"] == (r["profit_loss_usd"] > 0)


def test_unaffordable_and_invalid_signals_are_skipped(spark):
    assert trades.trade_outcomes(_signal(spark, close=126.0)).count() == 0
    assert trades.trade_outcomes(_signal(spark, close=0.0)).count() == 0
    flat = trades.trade_outcomes(_signal(spark), optimistic_exit=False).first()
    assert flat["exit_price"] == 2.0 and not flat["is_winner"]


def test_overlap_counts(spark):
    rows = [("a", "x", "1", 0.9), ("b", "x", "1", 0.9), ("c", "x", "1", 0.9), ("a", "y", "1", 0.9), ("b", "y", "1", 0.9), ("a", "z", "1", 0.9), ("b", "z", "1", 0.1)]
    df = spark.createDataFrame(rows, "model string, ticker string, entry_time string, proba double")
    got = compare.signal_overlap(df, 0.8).collect()
    assert {(r["n_agree"], r["models"]): r["signals"] for r in got} == {(1, "a"): 1, (2, "a,b"): 1, (3, "a,b,c"): 1}
    assert (got[0]["total_unique_signals"], got[0]["all_models_agree"], got[0]["majority_agree"]) == (3, 1, 2)
    silent = compare.signal_overlap(df.replace("c", "d", ["model"]).withColumn("proba", F.when(F.col("model") == "d", 0.1).otherwise(F.col("proba"))), 0.8)
    assert {r["all_models_agree"] for r in silent.collect()} == {0}
    none = compare.signal_overlap(df, 0.99).collect()
    assert [(r["n_agree"], r["signals"], r["total_unique_signals"], r["all_models_agree"]) for r in none] == [(0, 0, 0, 0)]


def test_insufficient_folds_are_marked(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 5.0, -1.0)], "split_index long, target int, proba double, max_gain_120m double, min_loss_120m double")
    train = spark.createDataFrame([(1, 9), (2, 50)], "split_index long, train_positives long")
    got = {r["split_index"]: r["status"] for r in compare.fold_metrics(rows, 0.5, train_positives=train).collect()}
    assert got == {1: "INSUFFICIENT_DATA", 2: "INSUFFICIENT_DATA"}


def test_risk_denominator_includes_null_losses(spark):
    fp = spark.createDataFrame([(-5.0,), (-25.0,), (0.0,), (None,)], "min_loss_120m double")
    r = risk.risk_report(fp).first()
    assert (r["total_false_positives"], r["pct_over_20pct"], r["stop_5pct_triggered_pct"], r["pct_0_to_5pct"]) == (4, 0.25, 0.25, 0.25)
    with pytest.raises(ValueError):
        risk.false_positives(fp)


def test_band_edges(spark):
    df = spark.createDataFrame([("moneyness", v, 0.1) for v in (0.9699, 0.97, 1.005, 1.0051, 1.03, 1.04)] + [("other", 1.23456, 0.1)],
                               "feature string, value double, impact double")
    got = {r["value"]: r["meaning"] for r in explain.interpret(df).collect()}
    assert got == {0.9699: "deep ITM", 0.97: "ITM", 1.005: "ATM", 1.0051: "OTM", 1.03: "OTM", 1.04: "deep OTM", 1.23456: "other = 1.235"}


def test_nearest_rank_latency(spark):
    df = spark.createDataFrame([("op", 1_000 * i, float(i), 10, i) for i in range(1, 151)],
                               "operation string, ended_ms long, seconds double, records long, id long")
    r = monitoring.latency_stats(df, ["ended_ms"]).first()
    assert (r["samples"], r["p50"], r["p95"], r["p99"]) == (100, 100.0, 145.0, 149.0)
    assert r["throughput"] == pytest.approx(61 * 10 / 60)


# ── sources and tables ───────────────────────────────────────────────────

def test_contract_arrays_and_missing_days(spark):
    root = scratch_path(spark, "contracts")
    os.makedirs(f"{root}/trade_date=2024-03-04")
    rows = [{"ticker": "a", "strike_price": 1.5, "contract_type": "call"}, {"ticker": "b", "strike_price": 2.0, "contract_type": "put"}]
    with open(f"{root}/trade_date=2024-03-04/list.json", "w") as fh:
        json.dump(rows, fh, indent=2)
    assert readers.scan_contracts(spark, root).count() == 2
    assert readers.scan_contracts(spark, root, start="2024-03-05").count() == 0


def test_feature_dates_come_from_file_names(spark):
    root = scratch_path(spark, "csv")
    os.makedirs(root)
    for day in ("2024-03-04", "2024-03-05", "2024-03-06"):
        pd.DataFrame({"timestamp": [1], "x": [2.0]}).to_csv(f"{root}/{day}_features.csv", index=False)
    schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("x", T.DoubleType())])
    got = readers.load_features(spark, root, schema, "2024-03-05", None, "csv", date_from_name=True)
    assert sorted(r["date"] for r in got.collect()) == ["2024-03-05", "2024-03-06"]


def test_date_bounds_prune_partitions(spark):
    path = scratch_path(spark, "bars")
    df = spark.createDataFrame([(1, 1.0, "spy", "2024-03-04"), (2, 1.0, "spy", "2024-03-05")], "timestamp long, close double, source string, trade_date string")
    tables.write_partitions(df, path, ("source", "trade_date"))
    got = readers.scan_bars(spark, path, "spy", "2024-03-05")
    assert got.count() == 1
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().executedPlan().toString()


def test_nan_is_read_as_null(spark):
    path = scratch_path(spark, "nan")
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("x", T.DoubleType())])
    spark.createDataFrame([("d", float("nan")), ("d", 1.0)], schema).write.parquet(path)
    assert sorted(r["x"] or 0.0 for r in readers.load_features(spark, path, schema).collect()) == [0.0, 1.0]
    assert readers.load_features(spark, path, schema).where("x is null").count() == 1


def test_rows_in_windows_respect_exact_bounds(spark):
    w = spark.createDataFrame([(1, "2024-01-15", "2024-03-10"), (2, "2024-03-01", "2024-03-31")], "split_index int, test_start string, test_end string")
    df = spark.createDataFrame([("2024-01-14",), ("2024-01-15",), ("2024-02-29",), ("2024-03-10",), ("2024-03-11",)], "date string")
    got = sorted((r["split_index"], r["date"]) for r in splits.rows_in_splits(df, w).collect())
    assert got == [(1, "2024-01-15"), (1, "2024-02-29"), (1, "2024-03-10"), (2, "2024-03-10"), (2, "2024-03-11")]


def test_upsert_touches_only_its_partitions_and_is_repeatable(spark):
    path = scratch_path(spark, "upsert")
    make = lambda rows: spark.createDataFrame(rows, "timestamp long, close double, trade_date string")
    tables.upsert_partitions(make([(1, 1.0, "d1"), (1, 2.0, "d1"), (2, 5.0, "d2")]), path, ("timestamp",), ("close",))
    for _ in range(2):
        tables.upsert_partitions(make([(1, 9.0, "d1"), (3, 4.0, "d1")]), path, ("timestamp",), ("close",))
    got = {(r["trade_date"], r["timestamp"]): r["close"] for r in spark.read.parquet(path).collect()}
    assert got == {("d1", 1): 9.0, ("d1", 3): 4.0, ("d2", 2): 5.0}


def test_news_sentiment_choice(spark):
    ins = lambda *t: [{"ticker": x, "sentiment": x + "!", "sentiment_reasoning": "r"} for x in t]
    base = {f: None for f in schemas.NEWS_RAW.fieldNames()}
    rows = [{**base, "id": "1", "published_utc": "2024-03-04T10:00:00Z", "insights": ins("B", "A", "A")},
            {**base, "id": "2", "published_utc": "bad", "insights": ins("B", "C")}, {**base, "id": "3", "insights": []}, {**base, "id": "4"}]
    got = readers.normalise_news(spark.createDataFrame(rows, schemas.NEWS_RAW), "A").orderBy("article_id").collect()
    assert [r["sentiment"] for r in got] == ["A!", "B!", None, None]
    assert [r["timestamp"] for r in got] == [1_709_546_400_000, None, None, None]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_plain_window_helpers(spark):
    w = ind.series_window()
    df = _bars(spark, [0.0, 2.0, 3.0]).withColumn("minutes_since_open", F.lit(None).cast("int"))
    rows = ind.layered(df, ind.lag_change("close", "chg", [1], w), [{"first": ind.change_from_first("close", w)}]).collect()
    assert [r["chg_1m"] for r in rows] == [0.0, 0.0, 0.0] and [r["first"] for r in rows] == [None] * 3
