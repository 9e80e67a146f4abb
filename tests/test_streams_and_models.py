"""Streams against batch results, and model plumbing."""

import pytest
from pyspark.sql import functions as F

from tickframe.operators import models
from tickframe.operators.metrics import classification_metrics
from tickframe.session import scratch_path
from tickframe.sources import views
from tickframe.streaming import ingest, windows


def _records(spark, rows):
    return spark.createDataFrame(rows, "timestamp long, open double, high double, low double, close double, volume long, vwap double, source string, n long")


def _bar(ts, close, n, ok=True):
    return (ts, 1.0, 1.0, 1.0, close if ok else None, 1, 1.0, "spy", n)


def test_ingest_resumes_and_replays_to_the_same_table(spark):
    day = 1_709_562_600_000
    path, table, spot, bad = (scratch_path(spark, n) for n in ("land", "table", "spot", "rejects"))
    first = _records(spark, [_bar(day, 1.0, 1), _bar(day, 2.0, 2), _bar(day + 1, 3.0, 3), _bar(day + 2, 3.0, 4, ok=False)])
    later = _records(spark, [_bar(day + 1, 9.0, 5), _bar(day + 86_400_000, 4.0, 6)])
    for part in (first, later):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = ingest.file_stream(spark, path, first.schema)
        ingest.ingest(stream, "spy", table, arrival=("n",), checkpoint=spot, rejects_path=bad).awaitTermination()
    read = lambda: {(str(r["trade_date"]), r["timestamp"]): r["close"] for r in spark.read.parquet(table).collect()}
    want = {("2024-03-04", day): 2.0, ("2024-03-04", day + 1): 9.0, ("2024-03-05", day + 86_400_000): 4.0}
    assert read() == want and spark.read.parquet(bad).count() == 1
    # every batch again, as after a lost checkpoint
    again = ingest.file_stream(spark, path, first.schema, 1)
    ingest.ingest(again, "spy", table, arrival=("n",)).awaitTermination()
    assert read() == want


def test_stream_bars_equal_batch_bars(spark, sf):
    t = views.ticks(spark, sf)
    path, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    ingest.lay_out(t, path)
    stream = windows.watermarked(ingest.file_stream(spark, path, t.schema), "0 seconds")
    shaped = windows.stream_bars(stream, ["ticker"], "15 minutes", "event_id")
    ingest.append_to(shaped, out).awaitTermination()
    cols = ["ticker", "ts_ms", "open", "high", "low", "close", "volume"]
    batch, live = views.bars(spark, sf).select(cols), spark.read.schema(shaped.schema).parquet(out).select(cols)
    last = t.agg(F.max("ts_ms")).first()[0]
    closed = batch.where(F.col("ts_ms") + views.BAR_MS <= last)
    assert live.exceptAll(closed).count() == 0 and closed.exceptAll(live).count() == 0


def test_late_rows_use_earlier_batches_only(spark):
    df = spark.createDataFrame([(1, 100), (1, 5), (2, 80), (2, 95), (2, 300), (3, 250)], "b long, ts long")
    got = {(r["b"], r["ts"]) for r in ingest.late_rows(df, "b", "ts", 10).collect()}
    assert got == {(2, 80), (3, 250)}


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(f"2024-01-{1 + i % 20:02d}", i, float(i % 10), 1 if i % 10 >= 7 else 0) for i in range(400)]
    return spark.createDataFrame(rows, "date string, timestamp long, x double, target int").withColumn("id", F.col("timestamp"))


def test_train_learns_saves_and_scores_the_same(spark, separable):
    artifact, scored = models.train(separable, ["x"], ["id"], params={"maxIter": 3, "maxDepth": 2})
    test = scored.where("split = 'test'")
    assert classification_metrics(test, 0.5).first()["f1"] == 1.0
    path = scratch_path(spark, "artifact")
    artifact.save(spark, path)
    loaded = models.Artifact.load(spark, path)
    assert loaded.features == ["x"]
    again = models.score(loaded.model, separable.drop("x").withColumn("x", F.col("timestamp") % 10), ["x"])
    assert again.select("id", F.round("proba", 9)).exceptAll(scored.select("id", F.round("proba", 9))).count() == 0
    weighted, _ = models.train(separable, ["x"], ["id"], "class_weights", params={"maxIter": 2, "maxDepth": 2})
    assert models.feature_importance(spark, weighted.model, ["x"]).first()["importance"] == pytest.approx(1.0)


def test_tune_zeroes_trials_with_too_few_positives(spark, separable):
    few = separable.withColumn("target", (F.col("timestamp") == 3).cast("int"))
    got = models.tune(few, ["x"], {"maxDepth": [1], "maxIter": [1]}, folds=2, tie=["id"]).first()
    assert got["score"] == 0.0
