"""Keyed stream state against plain recomputation, and streams that pause, end and go on."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickframe.session import scratch_path
from tickframe.sources.tables import read_table
from tickframe.streaming import ingest, state, windows

MIN = 60_000


def land(spark, rows, schema, path):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def batches_of(spark, batches, schema, run):
    """Land and drain one batch after the other."""
    path = scratch_path(spark, "landing")
    for rows in batches:
        kind = land(spark, rows, schema, path)
        run(ingest.file_stream(spark, path, kind)).awaitTermination()


def test_a_silent_key_is_reported_while_others_go_on(spark):
    out, spot = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    first = [("a", 0), ("a", 5 * MIN), ("b", 0)] + [("b", k * 10 * MIN) for k in range(1, 7)]
    second = [("b", 70 * MIN), ("b", 200 * MIN), ("b", 201 * MIN), ("c", 190 * MIN)]
    third = [("b", 210 * MIN), ("a", 212 * MIN), ("b", 212 * MIN), ("b", 230 * MIN), ("c", 231 * MIN)]
    seen = []

    def run(stream):
        alerts = state.stall_alerts(windows.watermarked(stream, "10 minutes"), ["ticker"])
        seen.append(alerts.schema)
        return ingest.append_to(alerts, out, spot)

    def reported():
        return sorted((r["ticker"], r["stalled_from_ms"] // MIN, r["overdue_ms"] // MIN) for r in spark.read.schema(seen[0]).parquet(out).collect())

    path = scratch_path(spark, "landing")
    for rows, want in ((first, [("a", 5, 20)]), (second, [("a", 5, 20), ("b", 70, 85)]), (third, [("a", 5, 20), ("b", 70, 85), ("c", 190, 205)])):
        kind = land(spark, rows, "ticker string, ts_ms long", path)
        run(ingest.file_stream(spark, path, kind)).awaitTermination()
        assert reported() == want  # a is reported once, though it stays silent, and again only when it falls silent again


def test_rows_out_of_order_close_gaps(spark):
    out, spot, seen = scratch_path(spark, "out"), scratch_path(spark, "checkpoint"), []

    def run(stream):
        alerts = state.stall_alerts(windows.watermarked(stream, "10 minutes"), ["ticker"])
        seen.append(alerts.schema)
        return ingest.append_to(alerts, out, spot)

    batches_of(spark, [[("a", 0), ("a", 20 * MIN)], [("a", 12 * MIN)], [("a", 60 * MIN)]], "ticker string, ts_ms long", run)
    assert [(r[0], r[1] // MIN) for r in spark.read.schema(seen[0]).parquet(out).collect()] == [("a", 20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_merge_as_a_batch_would(spark, seed):
    rng, out, spot = random.Random(seed), scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    batches, clock = [], 100 * MIN  # rows at time 0 are as old as the first watermark
    for _ in range(4):
        clock += rng.randint(5, 40) * MIN
        batches.append([(k, max(0, clock + rng.randint(-25, 25) * MIN)) for k in "abc" for _ in range(rng.randint(1, 5))])
    run = lambda s: ingest.keep_current(
        state.activity_spans(windows.watermarked(s, "10 hours"), ["ticker"]), out, ["ticker", "start_ms"], "start_ms", spot)
    batches_of(spark, batches, "ticker string, ts_ms long", run)
    times = defaultdict(list)
    for k, t in sorted(r for b in batches for r in b):
        if times[k] and t - times[k][-1][-1] <= 15 * MIN:
            times[k][-1].append(t)
        else:
            times[k].append([t])
    want = sorted((k, s[0], s[-1] + 15 * MIN, len(s)) for k, spans in times.items() for s in spans)
    got = read_table(spark, out).where("messages > 0").select("ticker", "start_ms", "end_ms", "messages").collect()
    assert sorted(map(tuple, got)) == want


def test_the_last_arrival_within_the_bound_wins(spark):
    out, spot, seen = scratch_path(spark, "out"), scratch_path(spark, "checkpoint"), []
    hour = 60 * MIN

    def run(stream):
        kept = state.last_within(windows.watermarked(stream, "30 minutes"), ["k"], ["n"], hour)
        seen.append(kept.schema)
        return ingest.append_to(kept, out, spot)

    schema = "k string, ts_ms long, n long, note string"
    batches = [[("a", 1, 1, "first"), ("b", 1, 2, None)], [("a", 51, 3, "correction"), ("a", 41, 4, "later correction")],
               [("a", 62, 5, "anew"), ("c", 81, 6, "stays open")], [("z", 161, 7, None)]]
    batches_of(spark, [[(k, t * MIN, n, note) for k, t, n, note in b] for b in batches], schema, run)
    got = sorted((r["k"], r["n"], r["note"]) for r in spark.read.schema(seen[0]).parquet(out).collect())
    assert got == [("a", 4, "later correction"), ("a", 5, "anew"), ("b", 2, None)]


def test_a_landing_after_the_end_still_counts(spark):
    out, spot = scratch_path(spark, "current"), scratch_path(spark, "checkpoint")
    run = lambda s: ingest.keep_current(
        windows.heartbeat(windows.watermarked(s, "10 minutes"), ["ticker"]), out, ["ticker", "beat_ms"], "beat_ms", spot)
    path = scratch_path(spark, "landing")
    wants = [{("a", 0): 2, ("a", 300): 1}, {("a", 0): 2, ("a", 300): 2, ("b", 900): 1}, {("a", 0): 2, ("a", 300): 2, ("b", 900): 3, ("a", 86_400): 1}]
    for rows, want in zip(([("a", 1_000), ("a", 2_000), ("a", 300_000)], [("a", 301_000), ("b", 900_000)], [("b", 900_001), ("b", 900_002), ("a", 86_400_000)]), wants):
        kind = land(spark, rows, "ticker string, ts_ms long", path)
        run(ingest.file_stream(spark, path, kind)).awaitTermination()
        assert {(r["ticker"], r["beat_ms"] // 1000): r["messages"] for r in read_table(spark, out).collect()} == want
    assert spark.read.parquet(path).where("ticker IS NULL").count() == 0


def test_accepted_and_late_rows_are_the_input_of_each_batch(spark):
    accepted, late, ledger, spot = (scratch_path(spark, n) for n in ("accepted", "late", "ledger", "checkpoint"))
    batches = [[(1, 100), (2, 5), (3, None)], [(4, 80), (5, 95), (6, 300)], [(7, 250), (8, 290), (9, 301)]]
    batches_of(spark, batches, "id long, ts_ms long", lambda s: ingest.route_late(s, accepted, late, ledger, "ts_ms", 10, spot))
    read = lambda p: sorted(r["id"] for r in spark.read.schema("id long, ts_ms long").parquet(p).collect())
    assert read(late) == [4, 7] and read(accepted) == [1, 2, 3, 5, 6, 8, 9]
    rows = spark.read.schema(ingest.LEDGER).parquet(ledger).orderBy("batch_id").collect()
    assert [(r["mark"], r["arrived"], r["accepted"], r["late"]) for r in rows] == [(None, 3, 3, 0), (90, 3, 2, 1), (290, 3, 2, 1)]
    # a lost checkpoint: all batches again, to the same folders
    path = scratch_path(spark, "landing")
    for b in batches[:1]:
        kind = land(spark, b, "id long, ts_ms long", path)
    ingest.route_late(ingest.file_stream(spark, path, kind), accepted, late, ledger, "ts_ms", 10).awaitTermination()
    assert read(late) == [4, 7] and spark.read.schema(ingest.LEDGER).parquet(ledger).agg(F.sum("arrived")).head()[0] == 9
