"""Price-move events per contract-day and the reports over them.

An event fixes where the search for the next one may start: it depends on the
restart bar alone.  The bars of one contract-day are one array, and a fold over
its positions inside the JVM carries the restart bar and the events found.
Contract-days are independent; a day of second bars is 23,400 numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import exchange_clock
from ..functions.contracts import option_type
from ..functions.indicators import SERIES
from ..functions.numeric import count_if, join_results, let, ratio

# Scan defaults and report bands.
WINDOW_BARS = 120
TRIGGER_PCT = 20.0
SUSTAIN_PCT = 10.0
RATE_BANDS = (50.0, 20.0)
LATE_HOUR, OPEN_HOUR = 15, 9
MORNING_HOURS = (9, 10, 11)
MORNING_SPREAD = 0.25
SKEW_BANDS = (2.0, 1.5)

def _first(values: Column, holds: Callable[[Column], Column], wanted: bool) -> Column:
    """The place (from 1) of the first value for which ``holds`` is ``wanted``, 0 if there is none; a missing value holds nothing."""
    return F.array_position(F.transform(values, lambda v: F.coalesce(holds(v), F.lit(False))), F.lit(wanted)).cast("int")


def _after(close: Column, bar: Column) -> Column:
    return F.slice(close, bar + 1, F.size(close))


def _stop(close: Column, bar: Column, level: Column) -> Column:
    """The bar after the first from ``bar`` on that is not at ``level``, or the end of the day."""
    return let(_first(_after(close, bar), lambda v: v >= level, False), lambda n: F.when(n == 0, F.size(close)).otherwise(bar + n))


def _backward_event(close: Column, window: int, up: float, hold: float) -> Callable[[Column, Column], Column]:
    """The event that bar ``t`` triggers if the last one ended before ``floor``, or NULL."""
    def event(floor: Column, t: Column) -> Column:
        begin = F.greatest(floor, t - window)
        past, now = F.slice(close, begin + 1, t - begin), F.get(close, t)
        found = lambda low: F.when((low > 0) & (now >= low * up), F.struct(
            (begin + F.array_position(past, low).cast("int") - 1).alias("anchor"), t.alias("trigger"), _stop(close, t, low * hold).alias("stop")))
        return let(F.array_min(past), found)
    return event


def _forward_event(close: Column, window: int, up: float, hold: float) -> Callable[[Column, Column], Column]:
    """The event that an entry at bar ``t`` has within the window, or NULL."""
    def event(floor: Column, t: Column) -> Column:
        entry, ahead = F.get(close, t), F.slice(close, t + 2, F.lit(window))
        found = lambda n: F.when(n > 0, F.struct(
            t.alias("anchor"), (t + n).alias("trigger"), _stop(close, t + n, entry * hold).alias("stop")))
        return F.when(entry > 0, let(_first(ahead, lambda v: v >= entry * up, True), found))
    return event


_EVENT = "struct<anchor:int,trigger:int,stop:int>"


def _scan(bars: DataFrame, find, window: int, trigger: float, sustain: float, ts: str) -> DataFrame:
    up, hold = 1 + trigger / 100, 1 + sustain / 100
    bar = F.struct(F.col(ts).alias("t"), F.nullif(F.col("close").cast("double"), F.lit(float("nan"))).alias("c"))
    days = (bars.groupBy(*SERIES).agg(F.array_sort(F.collect_list(bar)).alias("_bars"))
            .select(*SERIES, F.transform("_bars", lambda b: b["t"]).alias("_at"), F.transform("_bars", lambda b: b["c"]).alias("_close")))
    close, event = F.col("_close"), find(F.col("_close"), window, up, hold)
    none = F.lit(None).cast(_EVENT)

    def step(s: Column, t: Column) -> Column:
        got = F.when(t >= s["floor"], event(s["floor"], t)).otherwise(none)
        return let(got, lambda e: F.when(e.isNull(), s).otherwise(F.struct(
            e["stop"].alias("floor"), F.concat(s["events"], F.array(e)).alias("events"))))

    start = F.struct(F.lit(0).alias("floor"), F.array().cast(f"array<{_EVENT}>").alias("events"))
    found = days.select(*SERIES, "_at", "_close", F.explode(F.aggregate(
        F.sequence(F.lit(0), F.size(close) - 1), start, step, lambda s: s["events"])).alias("_e"))
    anchor, first = F.col("_e.anchor"), F.col("_e.trigger")
    base, price = F.get(close, anchor), F.get(close, first)
    run = F.slice(close, first + 1, F.col("_e.stop") - first)  # up to the bar that ended it
    count = lambda level: F.size(F.filter(run, lambda v: v >= level))
    return found.select(
        *SERIES, F.get("_at", anchor).alias("anchor_ms"), F.get("_at", first).alias("trigger_ms"), (first - anchor).cast("long").alias("bars_to_trigger"),
        ((price - base) / base * 100).alias("gain_pct"), count(base * up).cast("long").alias("above_trigger"),
        count(base * hold).cast("long").alias("above_sustain"), base.alias("anchor_price"), price.alias("trigger_price"))


def scan_backward(bars: DataFrame, window: int = WINDOW_BARS, trigger: float = TRIGGER_PCT,
                  sustain: float = SUSTAIN_PCT, ts: str = "ts_ms") -> DataFrame:
    """Bars standing ``trigger`` percent above the low of the prior window."""
    raw = _scan(bars, _backward_event, window, trigger, sustain, ts)
    return raw.select(
        F.col("trade_date").alias("date"), "ticker",
        exchange_clock(F.col("trigger_ms")).alias("trigger_time_et"),
        exchange_clock(F.col("anchor_ms")).alias("reference_time_et"),
        F.round("gain_pct", 2).alias("gain_pct"),
        F.col("above_trigger").alias("above_20pct_duration_min"),
        F.col("above_sustain").alias("above_10pct_duration_min"),
        F.round("anchor_price", 4).alias("reference_price"),
        F.round("trigger_price", 4).alias("trigger_price"),
    )


def scan_forward(bars: DataFrame, window: int = WINDOW_BARS, trigger: float = TRIGGER_PCT,
                 sustain: float = SUSTAIN_PCT, ts: str = "ts_ms") -> DataFrame:
    """Earliest entries whose price reaches ``trigger`` percent within the next window."""
    raw = _scan(bars, _forward_event, window, trigger, sustain, ts)
    return raw.select(
        F.col("trade_date").alias("date"), "ticker",
        exchange_clock(F.col("anchor_ms")).alias("entry_time_et"),
        exchange_clock(F.col("trigger_ms")).alias("trigger_time_et"),
        F.col("bars_to_trigger").alias("minutes_to_trigger"),
        F.round("gain_pct", 2).alias("gain_pct"),
        F.col("above_trigger").alias("above_20pct_duration_min"),
        F.col("above_sustain").alias("above_10pct_duration_min"),
        F.round("anchor_price", 4).alias("entry_price"),
        F.round("trigger_price", 4).alias("trigger_price"),
    )


def trigger_hour() -> Column:
    return F.coalesce(F.substring("trigger_time_et", 1, 2).try_cast("int"), F.lit(0))


def scan_summary(bars: DataFrame, events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Contract-days, bars, events and their spread; event-free days count as zero.

    Event counts and durations are integers of at most one day's bars, so the
    exact median keeps at most that many distinct values per group.
    """
    if "option_type" in by:
        bars = bars.withColumn("option_type", option_type(F.col("ticker")))
        events = events.withColumn("option_type", option_type(F.col("ticker")))
    keys = [*by, "date", "ticker"]
    days = (bars.withColumnRenamed("trade_date", "date").groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("bars")))
    hits = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    per_day = (days.join(hits, keys, "left").fillna(0, ["events"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("contract_days"), F.sum("bars").alias("total_bars"),
        F.sum("events").alias("total_events"), F.min("events").alias("min_events"),
        F.median("events").alias("median_events"), F.max("events").alias("max_events")))
    runs = events.groupBy(*by).agg(
        F.sum("above_20pct_duration_min").alias("minutes_above"),
        F.median("above_20pct_duration_min").alias("median_duration"),
        F.avg("above_20pct_duration_min").alias("mean_duration"))
    every = days.agg(F.sum("bars")).scalar()  # also by option type, the share is of all bars
    return (join_results(per_day, runs, by).withColumn("minutes_above", F.coalesce("minutes_above", F.lit(0))).withColumn("_every", every)
            .withColumn("positive_minute_rate",
                        F.coalesce(ratio(F.col("minutes_above") * 100.0, F.col("_every").cast("double")),
                                   F.lit(0.0))).drop("_every"))


def trigger_hours(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return events.withColumn("hour", trigger_hour()).groupBy(*by, "hour").agg(F.count(F.lit(1)).alias("events"))


def scan_observations(summary: DataFrame, hours: DataFrame) -> DataFrame:
    """Rule-based findings over one summary row and its hour histogram (24 rows at most)."""
    in_morning = F.col("hour").isin(*MORNING_HOURS)
    peaks = hours.agg(
        F.max_by("hour", F.struct("events", -F.col("hour"))).alias("peak_hour"),
        F.max("events").alias("peak_events"),
        count_if(in_morning).alias("morning_hours"),
        F.max(F.when(in_morning, F.col("events"))).alias("morning_max"),
        F.min(F.when(in_morning, F.col("events"))).alias("morning_min"),
        F.max_by("hour", F.when(in_morning, F.struct("events", -F.col("hour")))).alias("morning_peak"))
    both = join_results(summary, peaks, ())
    rate, mean, med = F.col("positive_minute_rate"), F.col("mean_duration"), F.col("median_duration")
    some = F.col("total_events") > 0
    return both.select(
        F.when(~some, "none").when(rate >= RATE_BANDS[0], "mostly_above")
        .when(rate >= RATE_BANDS[1], "often_above").otherwise("rarely_above").alias("rate_finding"),
        F.when(some, F.when(F.col("peak_hour") >= LATE_HOUR, "late_day")
               .when(F.col("peak_hour") <= OPEN_HOUR, "open").otherwise("mid_session")).alias("peak_finding"),
        "peak_hour", "peak_events",
        (F.col("peak_events") * 100.0 / F.nullif(F.col("total_events"), F.lit(0))).alias("peak_pct"),
        F.when(some & (F.col("morning_hours") >= 2),
               F.when(F.col("morning_max") - F.col("morning_min")
                      <= F.col("morning_max") * MORNING_SPREAD, "even").otherwise("peaked")
               ).alias("morning_finding"),
        "morning_peak",
        F.when(some, F.when(mean > SKEW_BANDS[0] * med, "heavy_skew")
               .when(mean > SKEW_BANDS[1] * med, "moderate_skew").otherwise("symmetric")).alias("skew_finding"),
    )


def event_dashboard(events: DataFrame) -> DataFrame:
    """Events per day and option type.  Medians are over bounded integers and 2-decimal gains."""
    return events.withColumn("option_type", option_type(F.col("ticker"))).groupBy("date", "option_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.median("minutes_to_trigger").alias("median_minutes_to_trigger"),
        F.median("gain_pct").alias("median_gain_pct"),
        F.median("above_20pct_duration_min").alias("median_above_20"),
        F.median("above_10pct_duration_min").alias("median_above_10"))


def event_filter(df: DataFrame, start: str | None = None, end: str | None = None,
                 option_types: Sequence[str] | None = None, winners: bool | None = None,
                 exit_reasons: Sequence[str] | None = None, date_col: str = "date") -> DataFrame:
    """Report filters; each is optional."""
    if start:
        df = df.where(F.col(date_col) >= start)
    if end:
        df = df.where(F.col(date_col) <= end)
    if option_types:
        df = df.where(option_type(F.col("ticker")).isin(*option_types))
    if winners is not None:
        df = df.where(F.col("is_winner") == winners)
    if exit_reasons:
        df = df.where(F.col("exit_reason").isin(*exit_reasons))
    return df
