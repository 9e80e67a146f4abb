"""Operational statistics: latency, throughput, errors, heartbeats, ingest counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_if, join_results
from .quantiles import exact_quantiles

# Windows and alert limits.
LAST_N = 100
THROUGHPUT_SECONDS = 60
MAX_LATENCY_S = 300.0
MIN_RECORDS_PER_S = 100.0
MAX_MEMORY_MB = 1000.0
ERROR_WINDOW_MS = 15 * 60_000
MAX_ERROR_PCT = 1.0
RECENT_ERRORS = 50
HEARTBEAT_MS = 5 * 60_000
STALL_MS = 15 * 60_000
P99_LIMIT_MS = 100.0


def latest_per_group(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """The newest snapshot per group."""
    rest = [c for c in df.columns if c not in by]
    return (df.groupBy(*by).agg(F.max_by(F.struct(*rest), ts).alias("_r"))
            .select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows per group; Spark trims to n per map task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _nearest_rank(values: Column, pct: int) -> Column:
    k = F.greatest(F.lit(0), F.floor(F.size(values) * F.lit(pct) / 100).cast("int") - 1)
    return F.get(values, k)


def _all_ranks(ops: DataFrame) -> DataFrame:
    counted = ops.where(F.col("seconds").isNotNull()).groupBy("operation", "seconds").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("operation").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    cum = counted.withColumn("_upto", F.sum("_c").over(upto))
    total = counted.groupBy("operation").agg(F.sum("_c").alias("samples"))
    rank = lambda p: F.greatest(F.lit(1), F.floor(F.col("samples") * F.lit(p) / 100))
    return cum.join(total, "operation").groupBy("operation").agg(
        F.max("samples").alias("samples"), *[F.min(F.when(F.col("_upto") >= rank(p), F.col("seconds"))).alias(f"p{p}") for p in (50, 95, 99)])


def latency_stats(ops: DataFrame, order: Sequence[str], now_ms: Column | None = None,
                  window_s: int = THROUGHPUT_SECONDS, ts: str = "ended_ms", runs: int | None = LAST_N) -> DataFrame:
    """Nearest-rank p50/p95/p99 over each operation's last ``runs`` runs, and recent throughput.

    With ``runs=None`` all runs count; their ranks come from counts per duration.
    """
    if runs is not None:
        recent = last_n(ops, ["operation"], order, runs).groupBy("operation").agg(
            F.sort_array(F.collect_list("seconds")).alias("_v"))  # ``runs`` values at most
        ranks = recent.select("operation", F.size("_v").cast("long").alias("samples"),
                              *[_nearest_rank(F.col("_v"), p).alias(f"p{p}") for p in (50, 95, 99)])
    else:
        ranks = _all_ranks(ops)
    now = now_ms if now_ms is not None else ops.agg(F.max(ts)).scalar()
    flow = (ops.withColumn("_now", now).where(F.col(ts) >= F.col("_now") - window_s * 1000)
            .groupBy("operation").agg(F.sum("records").alias("_n"), F.min(ts).alias("_t0"), F.max("_now").alias("_now")))
    span = (F.col("_now") - F.col("_t0")) / 1000.0
    flow = flow.select("operation", F.when(span > 0, F.col("_n") / span)
                       .otherwise(F.col("_n").cast("double")).alias("throughput"))
    return ranks.join(flow, "operation", "left").fillna(0.0, ["throughput"])


def operation_alerts(ops: DataFrame, max_latency: float = MAX_LATENCY_S, min_rate: float = MIN_RECORDS_PER_S,
                     max_memory: float = MAX_MEMORY_MB) -> DataFrame:
    """array<string> of the limits each operation run breaks."""
    checks = [F.when(F.col("seconds") > max_latency, F.lit("latency")),
              F.when((F.col("records") > 0) & (F.col("seconds") > 0)
                     & (F.col("records") / F.nullif(F.col("seconds"), F.lit(0.0)) < min_rate), F.lit("throughput"))]
    if "memory_mb" in ops.columns:
        checks.append(F.when(F.col("memory_mb") > max_memory, F.lit("memory")))
    return ops.withColumn("alerts", F.array_compact(F.array(*checks)))


def latency_percentiles(df: DataFrame, value: str = "latency_ms", by: Sequence[str] = (),
                        limit: float = P99_LIMIT_MS) -> DataFrame:
    """Mean, linear p50/p95/p99, maximum and whether p99 is under the limit."""
    q = exact_quantiles(df, by, value, {"p50": 0.50, "p95": 0.95, "p99": 0.99})
    head = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return join_results(head, q, by).withColumn("meets_target", F.col("p99") < limit)


def error_rate(events: DataFrame, window_ms: int = ERROR_WINDOW_MS, limit_pct: float = MAX_ERROR_PCT,
               ts: str = "ts_ms", is_error: str = "is_error", slice_ms: int = 3_600_000) -> DataFrame:
    """Error percentage over the trailing window at every event time.

    Events are first counted per millisecond.  Time is cut into slices, each
    also receiving the tail of the slice before it, so no window spans the
    whole history in one task.  A count enters its slice at its time and leaves
    with the opposite sign once the window has passed, so a window is a running
    sum and a slice is linear in its times, however many share a window.
    """
    points = events.groupBy(ts).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(is_error)).alias("e"))
    reach = window_ms // slice_ms + 1
    home = F.floor(F.col(ts) / slice_ms)
    spread = (points.withColumn("_home", home)
              .withColumn("_slice", F.explode(F.filter(
                  F.sequence(home, home + reach),
                  lambda s: (s == home) | (F.col(ts) >= s * slice_ms - window_ms)))))
    here = F.col("_slice") == F.col("_home")
    move = lambda at, sign, home: F.struct(at.alias("at"), (F.col("n") * sign).alias("n"), (F.col("e") * sign).alias("e"), home.alias("home"))
    moves = spread.select("_slice", F.inline(F.array(
        move(F.col(ts), 1, here), move(F.col(ts) + window_ms + 1, -1, F.lit(False))))).where(F.col("at") < (F.col("_slice") + 1) * slice_ms)
    w = Window.partitionBy("_slice").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    out = (moves.withColumn("total", F.sum("n").over(w)).withColumn("errors", F.sum("e").over(w))
           .where("home").withColumnRenamed("at", ts))
    rate = F.col("errors") * 100.0 / F.col("total")
    return out.select(ts, "total", "errors", rate.alias("rate_pct"), (rate > limit_pct).alias("alert"))


def error_summary(events: DataFrame, type_col: str = "error_type", is_error: str = "is_error") -> DataFrame:
    return events.where(F.col(is_error)).groupBy(type_col).agg(F.count(F.lit(1)).alias("errors"))


def recent_errors(events: DataFrame, order: Sequence[str], type_col: str = "error_type",
                  n: int = RECENT_ERRORS, is_error: str = "is_error") -> DataFrame:
    return last_n(events.where(F.col(is_error)), [type_col], order, n)


def ingest_stats(checked: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fetched, valid, invalid, duplicate and written counts of a validated batch."""
    good = F.size("errors") == 0
    per_key = checked.groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("_n"), count_if(good).alias("_v"))
    return per_key.groupBy(*by).agg(
        F.sum("_n").alias("fetched"), F.sum("_v").alias("valid"),
        F.sum(F.col("_n") - F.col("_v")).alias("invalid"),
        F.sum(F.greatest(F.col("_v") - 1, F.lit(0))).alias("duplicates"),
        count_if(F.col("_v") > 0).alias("written"))


def heartbeats(messages: DataFrame, by: Sequence[str], interval_ms: int = HEARTBEAT_MS, ts: str = "ts_ms") -> DataFrame:
    """Messages per interval, running total of the UTC day and last message time."""
    beat = F.col(ts) - F.pmod(F.col(ts), F.lit(interval_ms))
    beats = messages.groupBy(*by, beat.alias("beat_ms")).agg(
        F.count(F.lit(1)).alias("messages"), F.max(ts).alias("last_message_ms"))
    day = F.floor(F.col("beat_ms") / 86_400_000)
    w = Window.partitionBy(*by, day).orderBy("beat_ms").rowsBetween(Window.unboundedPreceding, 0)
    return beats.withColumn("total_today", F.sum("messages").over(w))


def stalls(messages: DataFrame, by: Sequence[str], limit_ms: int = STALL_MS, ts: str = "ts_ms") -> DataFrame:
    """Gaps between consecutive messages longer than the limit.

    Messages are reduced to the first and last of each limit-sized slot before
    they are ordered: a longer gap always spans two slots.
    """
    slot = F.floor(F.col(ts) / limit_ms)
    slots = messages.groupBy(*by, slot.alias("_slot")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    w = Window.partitionBy(*by).orderBy("_slot")
    gap = (slots.withColumn("stalled_from_ms", F.lag("last").over(w))
           .withColumn("resumed_ms", F.col("first"))
           .withColumn("gap_seconds", (F.col("first") - F.col("stalled_from_ms")) / 1000.0))
    return gap.where(F.col("gap_seconds") > limit_ms / 1000).select(
        *by, "stalled_from_ms", "resumed_ms", "gap_seconds")


def session_health(snapshots: DataFrame, now_ms: Column, by: Sequence[str] = ("session",), ts: str = "ts_ms",
                   stale_ms: int = STALL_MS) -> DataFrame:
    """Latest metrics per session and whether they are stale."""
    return (latest_per_group(snapshots, by, ts)
            .withColumn("age_ms", now_ms - F.col(ts)).withColumn("is_stale", F.col("age_ms") > stale_ms))
