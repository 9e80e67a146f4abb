"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickframe.catalog import everything  # noqa: E402
from tickframe.session import build_session  # noqa: E402

HEADLINE = (
    "A1_resample_ohlcv", "J1_asof_join_ticks", "J3_asof_many_series", "W12_macd", "W18_forward_labels", "W22_scan_forward",
    "G1_implied_vol", "U2_dedup_last", "W30_undersample_majority", "A15_backtest_metrics", "A17_threshold_sweep",
    "A25_monthly_trade_report", "A27_model_threshold_results", "R11_stream_bars", "C1_consolidate", "C4_engineer_ml_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog = everything()
    picked = os.environ.get("BENCH_QUERIES")
    names = list(catalog) if picked == "all" else picked.split(",") if picked else HEADLINE
    # start the JVM's code paths and the Python workers once, outside the timings
    catalog["W22_scan_forward"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
