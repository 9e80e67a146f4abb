"""One row per (minute, contract) from underlying bars and option bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import tte_days

OPTION_COLUMNS = ("ticker", "contract_type", "strike_price", "time_to_expiry_days", "option_avg_price")


def option_rows(options: DataFrame, contracts: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Option bars with contract terms; bars of unknown contracts are dropped.

    ``contracts`` is unique per (trade_date, ticker) and grows with the days
    covered, so the join strategy is left to the optimizer's size check.
    """
    terms = contracts.select("trade_date", "ticker", F.col("strike_price").cast("double").alias("strike_price"),
                             F.lower("contract_type").alias("contract_type"), "expiration_date")
    return (options.join(terms, ["trade_date", "ticker"])
            .withColumn("time_to_expiry_days", tte_days(F.col(ts), F.col("expiration_date")))
            .select("trade_date", ts, *OPTION_COLUMNS))


def flatten_per_option(underlying: DataFrame, option_side: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Inner join on the minute: minutes without an option bar drop out."""
    return underlying.join(option_side, ["trade_date", ts])


def underlying_only(underlying: DataFrame, option_side: DataFrame) -> DataFrame:
    """Bars of the days without any option row, with NULL option columns."""
    covered = option_side.select("trade_date").distinct()
    return underlying.join(covered, "trade_date", "left_anti")


def flatten_with_fallback(underlying: DataFrame, option_side: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Both cases in one pass over the underlying.

    Unmatched minutes survive only on days that have no option row at all; the
    list of covered days is one short row per calendar day.
    """
    covered = F.broadcast(option_side.select("trade_date").distinct().withColumn("_covered", F.lit(True)))
    joined = underlying.join(option_side, ["trade_date", ts], "left").join(covered, "trade_date", "left")
    return joined.where(F.col("ticker").isNotNull() | F.col("_covered").isNull()).drop("_covered")
