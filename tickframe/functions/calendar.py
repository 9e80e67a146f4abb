"""Session clock and calendar expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exchange session.
EXCHANGE_TZ = "America/New_York"
OPEN_MINUTE = 9 * 60 + 30
CLOSE_MINUTE = 16 * 60
SESSION_MINUTES = 390
MORNING_MINUTES = 120
LAST_HOUR_START = 330


def utc_ts(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def partition_date(ts_ms: Column) -> Column:
    """UTC calendar date as YYYY-MM-DD (session time zone is UTC)."""
    return F.date_format(utc_ts(ts_ms), "yyyy-MM-dd")


def exchange_ts(ts_ms: Column) -> Column:
    """Exchange wall-clock time."""
    return F.from_utc_timestamp(utc_ts(ts_ms), EXCHANGE_TZ)


def exchange_clock(ts_ms: Column) -> Column:
    return F.date_format(exchange_ts(ts_ms), "HH:mm:ss")


def session_minutes(ts_ms: Column) -> Column:
    """Whole minutes since the 09:30 open (negative before it)."""
    et = exchange_ts(ts_ms)
    return F.hour(et) * 60 + F.minute(et) - OPEN_MINUTE


def add_clock_features(df: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """hour_et … is_last_hour from a millisecond timestamp."""
    et = exchange_ts(F.col(ts))
    mso = F.col("minutes_since_open")
    return (
        df.withColumn("hour_et", F.hour(et))
        .withColumn("minute_et", F.minute(et))
        .withColumn("minute_of_day", F.col("hour_et") * 60 + F.col("minute_et"))
        .withColumn("minutes_since_open", F.col("minute_of_day") - OPEN_MINUTE)
        .withColumn("is_morning", (mso < MORNING_MINUTES).cast("int"))
        .withColumn("pct_day_elapsed",
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), mso / F.lit(float(SESSION_MINUTES)))))
        .withColumn("is_last_hour", (mso >= LAST_HOUR_START).cast("int"))
    )


def _not_holiday(day: Column, holidays: Sequence[str]) -> Column:
    days = [dt.date.fromisoformat(h) for h in holidays]
    return ~day.isin(days) if days else F.lit(True)


def _millis_of_day(ts_ms: Column) -> Column:
    et = exchange_ts(ts_ms)
    seconds = F.hour(et) * 3600 + F.minute(et) * 60 + F.second(et)
    return seconds * 1000 + F.pmod(ts_ms, F.lit(1000))


def market_open(ts_ms: Column, holidays: Sequence[str] = ()) -> Column:
    """Weekday, no holiday, 09:30:00 to 16:00:00 exchange time, both inclusive."""
    day = F.to_date(exchange_ts(ts_ms))
    return (
        (F.weekday(day) < 5) & _not_holiday(day, holidays)
        & _millis_of_day(ts_ms).between(OPEN_MINUTE * 60_000, CLOSE_MINUTE * 60_000)
    )


def next_session_day(day: Column, holidays: Sequence[str] = ()) -> Column:
    """First trading day on or after ``day``.

    A weekend moves to its Monday; a listed holiday, then, to the day the list says the
    exchange opens again, one entry per holiday.
    """
    monday = F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))
    closed = {dt.date.fromisoformat(h) for h in holidays}
    if not closed:
        return monday

    def opens(d: dt.date) -> dt.date:
        while d in closed or d.weekday() >= 5:
            d += dt.timedelta(days=1)
        return d

    moved = F.create_map(*[F.lit(x) for h in sorted(closed) for x in (h, opens(h))])
    return F.coalesce(F.try_element_at(moved, monday), monday)


def _at_exchange_minute(day: Column, minute: int) -> Column:
    """UTC epoch seconds of an exchange wall-clock minute on ``day``."""
    local = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + minute * 60)
    return F.unix_timestamp(F.to_utc_timestamp(local, EXCHANGE_TZ))


def seconds_to_open(ts_ms: Column, holidays: Sequence[str] = ()) -> Column:
    """NULL while open, else whole elapsed seconds to the next session's open."""
    et = exchange_ts(ts_ms)
    today = F.to_date(et)
    after_close = _millis_of_day(ts_ms) > CLOSE_MINUTE * 60_000
    start = next_session_day(F.when(after_close, F.date_add(today, 1)).otherwise(today), holidays)
    wait = _at_exchange_minute(start, OPEN_MINUTE) - ts_ms / F.lit(1000.0)
    return F.when(~market_open(ts_ms, holidays), wait.cast("long"))


def seconds_to_close(ts_ms: Column, holidays: Sequence[str] = ()) -> Column:
    """Whole seconds to 16:00 while open, else NULL."""
    today = F.to_date(exchange_ts(ts_ms))
    left = _at_exchange_minute(today, CLOSE_MINUTE) - ts_ms / F.lit(1000.0)
    return F.when(market_open(ts_ms, holidays), left.cast("long"))


def resolve_expiry(day: Column, convention: str, offset: int = 1, fixed: str | None = None) -> Column:
    """Expiry date of a contract listed on ``day`` under a naming convention."""
    if convention == "fixed":
        base = F.to_date(F.lit(fixed))
    elif convention == "next_calendar_day":
        base = F.date_add(day, 1)
    elif convention == "next_trading_day":
        base = F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))
    elif convention == "next_friday":
        base = F.next_day(day, "Fri")
    else:
        raise ValueError(f"unknown expiry convention {convention!r}")
    return F.date_add(base, offset - 1)


def tte_days(ts_ms: Column, expiry: Column) -> Column:
    """Days from the bar to expiry 00:00 UTC; negative past it, NULL on a bad date."""
    day = F.try_to_date(expiry, "yyyy-MM-dd")
    return (F.unix_date(day).cast("long") * 86_400_000 - ts_ms) / F.lit(86_400_000.0)
