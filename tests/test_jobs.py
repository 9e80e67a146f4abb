"""Jobs: tables written by day, statistics of what was written, reports in long form."""

import math

from tickframe.plans import jobs, reports
from tickframe.sources.tables import read_table

DAYS = "trade_date string, ts_ms long, ticker string, target int, extra double"


def _rows(spark, rows):
    return spark.createDataFrame(rows, DAYS)


def test_a_run_replaces_its_days_and_counts_only_them(spark, tmp_path):
    path = str(tmp_path / "features")
    first = _rows(spark, [("2024-01-01", 1, "a", 1, 0.5), ("2024-01-01", 2, "b", 0, 0.5), ("2024-01-02", 1, "a", 0, 0.5)])
    jobs.run_features(first, path)
    again = _rows(spark, [("2024-01-02", 5, "c", 1, 1.5), ("2024-01-02", 6, "c", 0, 1.5), ("2024-01-05", 5, "c", 0, None),
                          ("2024-02-01", 1, "z", 1, 0.0)])
    done = jobs.run_features(again, path, "2024-01-02", "2024-01-06")
    assert done.stats.first().asDict() == {"dates_processed": 2, "total_rows": 3, "total_contracts": 2,
                                           "positive_rate": 1 / 3, "dates_skipped": 3}
    assert sorted(r["ts_ms"] for r in done.rows.collect()) == [5, 5, 6]
    stored = sorted((r["trade_date"], r["ts_ms"], r["ticker"]) for r in read_table(spark, path).collect())
    assert stored == [("2024-01-01", 1, "a"), ("2024-01-01", 2, "b"), ("2024-01-02", 5, "c"), ("2024-01-02", 6, "c"), ("2024-01-05", 5, "c")]


def test_a_run_without_rows_or_with_rows_without_a_day(spark, tmp_path):
    path = str(tmp_path / "features")
    jobs.run_features(_rows(spark, [("2024-01-01", 1, "a", 1, 0.5)]), path)
    empty = jobs.run_features(_rows(spark, []), path, "2024-01-01", "2024-01-02")
    assert empty.rows.count() == 0
    assert empty.stats.first().asDict() == {"dates_processed": 0, "total_rows": 0, "total_contracts": 0,
                                            "positive_rate": None, "dates_skipped": 2}
    undated = jobs.write_days(_rows(spark, [(None, 7, "n", 0, 0.0)]), path)
    assert [(r["trade_date"], r["ts_ms"]) for r in undated.collect()] == [(None, 7)]
    assert read_table(spark, path).count() == 2


def test_the_plan_of_a_job_runs_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = _rows(spark, [("2024-01-01", i, "a", 0, 0.0) for i in range(40)]).mapInPandas(watched, DAYS)
    done = jobs.run_features(df, str(tmp_path / "once"))
    assert done.stats.first()["total_rows"] == 40 and done.rows.count() == 40
    assert seen.value == 40


def test_preparation_counts_days_that_lose_all_rows(spark, tmp_path):
    bars = _rows(spark, [("2024-01-01", 1, "a", 0, 0.0), ("2024-01-01", 2, "a", 0, 0.0), ("2024-01-02", 1, "a", 0, 0.0)])
    done = jobs.run_preparation(bars, bars.where("ts_ms = 2"), str(tmp_path / "prepared"))
    got = {r["trade_date"]: (r["rows_in"], r["rows_out"], r["rows_filtered"], r["distinct_options"]) for r in done.stats.collect()}
    assert got == {"2024-01-01": (2, 1, 1, 1), "2024-01-02": (1, 0, 1, 0)}


def test_long_form_keeps_every_value(spark):
    a = spark.createDataFrame([("x", 0.7, 3, True, None), (None, 0.75, 4, False, "t")],
                              "model string, threshold double, n long, ok boolean, note string")
    b = spark.createDataFrame([(1.5, [1])], "v double, nested array<int>")
    got = {(r["output"], r["key"], r["measure"]): (r["number"], r["label"]) for r in reports.long_form(
        {"results": a, "one": b}).collect()}
    assert got == {
        ("results", "x|0.70", "n"): (3.0, None), ("results", "x|0.70", "ok"): (1.0, None), ("results", "x|0.70", "note"): (None, None),
        ("results", "|0.75", "n"): (4.0, None), ("results", "|0.75", "ok"): (0.0, None), ("results", "|0.75", "note"): (None, "t"),
        ("one", "", "v"): (1.5, None)}


def test_scan_events_go_to_a_table(spark, tmp_path):
    close = [1.0, 1.0, 1.3, 1.3, 1.0, 1.0]
    bars = spark.createDataFrame([("O:UND240105C00025000", "2024-01-02", 1704200400000 + 60_000 * i, c) for i, c in enumerate(close)],
                                 "ticker string, trade_date string, ts_ms long, close double")
    path = str(tmp_path / "events")
    found = reports.scan_and_report(bars, True, path, window=8)
    assert found["summary"].first()["total_events"] == read_table(spark, path).count() == found["events"].count() > 0
    rows = reports.long_form({k: v for k, v in found.items() if k != "events"}).collect()
    assert {r["output"] for r in rows} == {"summary", "hours", "by_type", "findings"}
    assert all(r["number"] is None or not math.isnan(r["number"]) for r in rows)
