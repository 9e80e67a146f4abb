"""Inputs on which results were once lost or falsified without an error."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions import indicators as ind
from tickframe.operators import explain, labels, monitoring, scanners, selection
from tickframe.operators.asof import asof_join
from tickframe.session import scratch_path
from tickframe.sources import readers, tables
from tickframe.streaming import ingest, windows


def test_exponential_means_on_long_days(spark):
    """One session of second bars, against the recursion."""
    n = 23_400
    close = np.cumsum(np.random.default_rng(3).normal(0, 1, n)) + 500
    df = spark.createDataFrame(pd.DataFrame({"ticker": "a", "trade_date": "d", "ts_ms": np.arange(n) * 1000, "close": close}))
    w = ind.series_window()
    out = ind.layered(df, ind.ema("close", 9, "fast", w), ind.ema("close", 200, "slow", w), ind.rsi("close", "rsi", w)).orderBy("ts_ms").toPandas()
    for name, span in (("fast", 9), ("slow", 200)):
        want = pd.Series(close).ewm(span=span, adjust=False, min_periods=span).mean()
        assert np.allclose(out[name], want, rtol=1e-9, atol=0, equal_nan=True)
    step = pd.Series(close).diff()
    up, down = (x.where(x > 0, 0.0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (step, -step))
    want = (100 - 100 / (1 + up / down)).where(down != 0, 100.0)[13:]
    assert out["rsi"].notna().sum() == n - 13 and np.allclose(out["rsi"][13:], want, rtol=1e-8)
    with pytest.raises(ValueError):
        ind.ewm(F.col("close"), "x", 0.95, w, 1)


def test_upsert_keeps_columns_a_batch_lacks(spark):
    path = scratch_path(spark, "upsert")
    full = spark.createDataFrame([(1, 1.0, "x", "d1"), (2, 2.0, "y", "d1"), (3, 3.0, "z", "d2")], "timestamp long, close double, note string, trade_date string")
    tables.upsert_partitions(full, path, ("timestamp",), ("close",))
    short = spark.createDataFrame([(2, 9.0, 5, "d1"), (2, 8.0, 6, "d1"), (4, 4.0, 7, "d1")], "timestamp long, close double, extra int, trade_date string")
    tables.upsert_partitions(short, path, ("timestamp",), ("extra",))
    got = {r["timestamp"]: (r["close"], r["note"], r["extra"]) for r in spark.read.option("mergeSchema", "true").parquet(path).collect()}
    assert got == {1: (1.0, "x", None), 2: (8.0, None, 6), 3: (3.0, "z", None), 4: (4.0, None, 7)}
    with pytest.raises(ValueError):
        tables.upsert_partitions(short, path, ("timestamp",), ())
    assert {r["timestamp"]: (r["note"], r["extra"]) for r in tables.read_table(spark, path).collect()} == {k: v[1:] for k, v in got.items()}


def test_upsert_opens_only_files_of_touched_days(spark):
    path = scratch_path(spark, "upsert")
    rows = [(k, float(k), f"2024-01-{1 + k % 9:02d}") for k in range(90)] + [(99, 1.0, None)]
    full = spark.createDataFrame(rows, "timestamp long, close double, trade_date string")
    tables.upsert_partitions(full, path, ("timestamp",), ("close",))
    few = spark.createDataFrame([(3, 7.0, "2024-01-04", 1), (500, 7.0, "2024-02-01", 1), (99, 2.0, None, 1)],
                                "timestamp long, close double, trade_date string, extra int")
    read = tables.stored_partitions(few, path, ("trade_date",))
    days = {f.split("trade_date=")[1].split("/")[0] for f in read.inputFiles()}
    assert days == {"2024-01-04", "__HIVE_DEFAULT_PARTITION__"} and read.count() == 11
    before = {f for f in spark.read.parquet(path).inputFiles() if "2024-01-04" not in f and "HIVE" not in f}
    tables.upsert_partitions(few, path, ("timestamp",), ("close",))
    stored = tables.read_table(spark, path)
    assert before <= set(stored.inputFiles())
    assert {r["timestamp"]: (r["close"], r["extra"]) for r in stored.where("timestamp in (3, 99, 500, 12)").collect()} == {
        3: (7.0, 1), 99: (2.0, 1), 500: (7.0, 1), 12: (12.0, None)}
    # a table whose side file was never written
    os.remove(f"{path}/_columns.json")
    assert tables.table_schema(spark, path).names == ["timestamp", "close", "extra", "trade_date"]


def test_times_missing_on_the_right_match_nothing(spark):
    left = spark.createDataFrame([(5, "d", 1)], "ts_ms long, trade_date string, a int")
    right = spark.createDataFrame([(None, "d", 99), (9, "d", 3)], "ts_ms long, trade_date string, b int")
    for width in (None, 1000):
        assert asof_join(left, right, slice_width=width).first()["b"] is None


def test_csv_columns_are_taken_by_name(spark):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.LongType())])
    root = scratch_path(spark, "csv")
    os.makedirs(root)
    with open(f"{root}/one.csv", "w") as fh:
        fh.write("b,a,x\n1.5,2.5,7\n")
    row = readers.load_features(spark, root, schema, fmt="csv").first()
    assert (row["a"], row["b"], row["c"]) == (2.5, 1.5, None)
    with open(f"{root}/two.csv", "w") as fh:
        fh.write("a,b,x\n1.5,2.5,7\n")
    with pytest.raises(Exception):
        readers.load_features(spark, root, schema, fmt="csv").collect()


def test_unreadable_files_fail_or_are_named(spark):
    schema = T.StructType([T.StructField("a", T.LongType())])
    root = scratch_path(spark, "broken")
    spark.range(3).select(F.col("id").alias("a")).coalesce(1).write.parquet(root)
    with open(f"{root}/bad.parquet", "w") as fh:
        fh.write("not parquet at all")
    with pytest.raises(Exception):
        readers.load_features(spark, root, schema).collect()
    rows = readers.load_features(spark, root, schema, skip_unreadable=True)
    assert rows.count() == 3
    assert [r["_file"].rsplit("/", 1)[1] for r in readers.files_without_rows(spark, root, rows).collect()] == ["bad.parquet"]


def test_bands_at_their_bounds(spark):
    rows = [("spy_macd", 5e-10), ("spy_macd", 0.0), ("moneyness", 1.03), ("moneyness", 1.03 + 5e-10), ("spy_vol_regime", 2.0), ("spy_vol_regime", 0.5),
            ("spy_vol_regime", 1.5), ("spy_vol_regime", 9.0)]
    got = [r["meaning"] for r in explain.interpret(spark.createDataFrame(rows, "feature string, value double")).collect()]
    assert got == ["bullish", "bearish", "OTM", "deep OTM", "high", "low", "high", "spy_vol_regime = 9.000"]


def test_vectors_with_repeated_times(spark):
    rows = [("a", "d", 0, 1.0), ("a", "d", 0, 1.5), ("a", "d", 60_000, 2.0), ("a", "d", 90_000, 7.0), ("a", "d", 180_000, None), ("a", "d", 240_000, 4.0)]
    df = spark.createDataFrame(rows, "ticker string, trade_date string, ts_ms long, close double")
    got = {(r["ts_ms"], r["close"]): r["target_future_prices"] for r in labels.future_price_vector(df, 4).collect()}
    assert got[0, 1.0] == got[0, 1.5] == [2.0, None, None, 4.0] and got[60_000, 2.0] == [None, None, 4.0, None]
    assert got[240_000, 4.0] == [None] * 4


def test_a_missing_close_is_a_bar_and_ends_a_run(spark):
    close = [10.0, 13.0, None, 13.0, 13.0]
    df = spark.createDataFrame([("a", "2024-03-04", k * 60_000, c) for k, c in enumerate(close)], "ticker string, trade_date string, ts_ms long, close double")
    first = scanners.scan_backward(df, window=10).orderBy("trigger_time_et").first()
    assert first["above_20pct_duration_min"] == 1
    far = spark.createDataFrame([("a", "2024-03-04", k * 60_000, c) for k, c in enumerate([10.0, None, None, 13.0])], df.schema)
    assert scanners.scan_backward(far, window=2).count() == 0 and scanners.scan_backward(far, window=3).count() == 1


def test_all_runs_and_all_symbols(spark):
    ops = spark.createDataFrame([("x", float(k), 1, k) for k in range(250)], "operation string, seconds double, records long, ended_ms long")
    got = monitoring.latency_stats(ops, ["ended_ms"], runs=None).first()
    assert (got["samples"], got["p50"], got["p99"]) == (250, 124.0, 246.0)
    assert monitoring.latency_stats(ops, ["ended_ms"]).first()["samples"] == 100
    listed = spark.createDataFrame([(f"s{k}", 100.0, "2024-03-05") for k in range(30)], "ticker string, strike_price double, expiration_date string")
    opens = spark.createDataFrame([("2024-03-04", 100.0)], "trade_date string, opening_price double")
    assert selection.discover_in_range(listed, opens, 0.03, 1).count() == 30
    assert selection.discover_in_range(listed, opens, 0.03, 1, 10).count() == 10


def test_metrics_of_every_batch(spark):
    path, out, metrics = (scratch_path(spark, n) for n in ("landing", "out", "metrics"))
    spark.range(12).repartition(6).write.parquet(path)
    stream = ingest.file_stream(spark, path, T.StructType([T.StructField("id", T.LongType())]), 1)
    query, log = ingest.append_measured(stream, out, metrics, F.col("id") == 3)
    query.awaitTermination()
    log.finish()
    got = spark.read.schema(ingest.METRICS).parquet(metrics)
    rows = got.orderBy("batch_id").collect()
    assert [r["batch_id"] for r in rows] == list(range(len(rows))) and len(rows) >= 6
    assert sum(r["records"] for r in rows) == 12 and sum(r["rejected"] for r in rows) == 1
    assert spark.read.schema(stream.schema).parquet(out).count() == 11
    stats = monitoring.latency_stats(got, ["ended_ms"]).first()
    assert stats["samples"] == len(rows) and stats["p99"] >= stats["p50"] > 0
