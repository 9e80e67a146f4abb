"""Contract selection around the day's opening price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import resolve_expiry
from ..functions.contracts import build_symbol, strike_ladder

# Matching tolerance and probed expiry offsets.
STRIKE_TOLERANCE = 0.01
EXPIRY_OFFSETS = (1, 2, 3, 4, 5)


def ladder_rows(opens: DataFrame, n_calls: int, n_puts: int, increment: float = 1.0) -> DataFrame:
    """(day columns, contract_type, position, strike_price) around ``opening_price``."""
    rungs = strike_ladder(F.col("opening_price"), n_calls, n_puts, increment)
    return opens.select("*", F.inline(rungs))


def construct_contracts(opens: DataFrame, underlying: str, n_calls: int, n_puts: int, convention: str,
                        increment: float = 1.0, fixed: str | None = None) -> DataFrame:
    """Candidate contracts per day: ladder, expiry and symbol."""
    expiry = resolve_expiry(F.to_date("trade_date"), convention, 1, fixed)
    return (ladder_rows(opens, n_calls, n_puts, increment)
            .withColumn("expiration_date", expiry)
            .withColumn("ticker", build_symbol(F.lit(underlying), F.col("expiration_date"),
                                               F.col("contract_type"), F.col("strike_price"))))


def discover_in_range(contracts: DataFrame, opens: DataFrame, pct: float, lookahead_days: int,
                      cap: int | None = None) -> DataFrame:
    """Listed contracts within ±pct of the open and the given expiry; with ``cap`` the first symbols per day."""
    spot = F.col("opening_price")
    lo, hi = F.round(spot * (1 - pct), 2), F.round(spot * (1 + pct), 2)
    want = opens.select("trade_date", lo.alias("_lo"), hi.alias("_hi"),
                        F.date_add(F.to_date("trade_date"), lookahead_days).alias("expiration_date"))
    listed = contracts.withColumn("expiration_date", F.to_date("expiration_date"))
    hit = listed.join(want, "expiration_date").where(
        (F.col("strike_price") >= F.col("_lo")) & (F.col("strike_price") <= F.col("_hi")))
    hit = hit.drop("_lo", "_hi")
    if cap is None:
        return hit
    w = Window.partitionBy("trade_date").orderBy("ticker")
    return hit.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def first_expiry(contracts: DataFrame, ranges: DataFrame, offsets: Sequence[int] = EXPIRY_OFFSETS) -> DataFrame:
    """trade_date → earliest probed expiry listing any strike in the day's [lo, hi].

    Contracts are reduced to distinct (expiry, strike) first; an expiry is
    probed by at most one day per offset.
    """
    probe = (ranges.withColumn("_o", F.explode(F.array(*[F.lit(o) for o in offsets])))
             .withColumn("expiration_date", F.date_add(F.to_date("trade_date"), F.col("_o"))))
    listed = contracts.select(F.to_date("expiration_date").alias("_e"), F.col("strike_price").alias("_k")).distinct()
    found = probe.join(listed, (F.col("expiration_date") == F.col("_e"))
                       & (F.col("_k") >= F.col("lo")) & (F.col("_k") <= F.col("hi")), "left_semi")
    return found.groupBy("trade_date").agg(F.min("expiration_date").alias("expiration_date"))


def targeted_selection(contracts: DataFrame, opens: DataFrame, n_calls: int, n_puts: int, increment: float = 1.0,
                       offsets: Sequence[int] = EXPIRY_OFFSETS) -> DataFrame:
    """Listed contracts matching the ladder within 0.01 at the first expiry with strikes in range.

    The approximate strike match is an equality on cents, probed in the two
    neighbouring cents as well, with the exact distance as residual.
    """
    cents = F.round(F.col("strike_price") * 100).cast("long")
    rungs = ladder_rows(opens.select("trade_date", "opening_price"), n_calls, n_puts, increment)
    ranges = rungs.groupBy("trade_date").agg(F.min("strike_price").alias("lo"), F.max("strike_price").alias("hi"))
    wanted = rungs.select("trade_date", "contract_type", F.col("strike_price").alias("_rung"),
                          F.explode(F.array(cents - 1, cents, cents + 1)).alias("_cents"))
    wanted = wanted.join(first_expiry(contracts, ranges, offsets), "trade_date")
    listed = contracts.select("ticker", "strike_price", F.lower("contract_type").alias("contract_type"),
                              F.to_date("expiration_date").alias("expiration_date"), cents.alias("_cents"))
    near = F.abs(F.col("strike_price") - F.col("_rung")) < STRIKE_TOLERANCE
    found = (wanted.join(listed, ["expiration_date", "contract_type", "_cents"]).where(near)
             .dropDuplicates(["trade_date", "ticker"]))
    call = F.col("contract_type") == "call"
    nearest = F.when(call, F.col("strike_price")).otherwise(-F.col("strike_price"))
    w = Window.partitionBy("trade_date", "contract_type").orderBy(nearest, "ticker")
    return (found.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.when(call, n_calls).otherwise(n_puts))
            .select("trade_date", "contract_type", "rank", "ticker", "strike_price", "expiration_date"))
