"""Option symbols, strike ladders and contract measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ratio

# Symbol pattern and the fallback for an unreadable symbol.
SYMBOL_PATTERN = r"(?i)(\d{6})([CP])(\d{8,15})$"
TYPE_PATTERN = r"\d([CP])\d"
FALLBACK_STRIKE = 400.0
FALLBACK_DAYS = 1.0
FALLBACK_FLAG = "c"
MIN_DAYS = 0.01


def parse_symbol(ticker: Column, trade_date: Column) -> Column:
    """struct(strike, tte_days, flag) from a symbol ending in yyMMdd, C/P, strike*1000."""
    ymd = F.regexp_extract(ticker, SYMBOL_PATTERN, 1)
    strike = F.regexp_extract(ticker, SYMBOL_PATTERN, 3).try_cast("bigint").cast("double") / 1000
    expiry = F.try_to_date(F.concat(F.lit("20"), ymd), "yyyyMMdd")
    days = F.datediff(expiry, F.try_to_date(trade_date, "yyyy-MM-dd")).cast("double")
    ok = (ymd != "") & days.isNotNull()
    return F.struct(
        F.when(ok, strike).otherwise(F.lit(FALLBACK_STRIKE)).alias("strike"),
        F.when(ok, F.greatest(days, F.lit(MIN_DAYS))).otherwise(F.lit(FALLBACK_DAYS)).alias("tte_days"),
        F.when(ok, F.lower(F.regexp_extract(ticker, SYMBOL_PATTERN, 2)))
        .otherwise(F.lit(FALLBACK_FLAG)).alias("flag"),
    )


def build_symbol(underlying: Column, expiry: Column, kind: Column, strike: Column) -> Column:
    """O:{UNDERLYING}{yyMMdd}{C|P}{strike*1000, at least 8 digits}."""
    letter = F.when(F.lower(F.substring(kind, 1, 1)) == "c", "C").otherwise("P")
    mills = F.round(strike * 1000).cast("long")
    code = F.when(mills.isNotNull(), F.format_string("%08d", mills))
    return F.concat(F.lit("O:"), F.upper(underlying), F.date_format(expiry, "yyMMdd"), letter, code)


def option_type(ticker: Column, unknown: str = "?") -> Column:
    """C or P, else the caller's marker."""
    kind = F.regexp_extract(ticker, TYPE_PATTERN, 1)
    return F.when(kind == "", F.lit(unknown)).otherwise(kind)


def strike_ladder(spot: Column, n_calls: int, n_puts: int, increment: float = 1.0) -> Column:
    """array<struct(contract_type, position, strike_price)>.

    Calls are the n multiples strictly above spot, puts the n multiples at or
    below it, both nearest first.
    """
    step = F.lit(float(increment))
    below = F.floor(spot / step + 1e-9)
    calls = F.transform(F.sequence(F.lit(1), F.lit(n_calls)), lambda i: F.struct(
        F.lit("call").alias("contract_type"), i.alias("position"),
        F.round((below + i) * step, 6).alias("strike_price"))) if n_calls else None
    puts = F.transform(F.sequence(F.lit(1), F.lit(n_puts)), lambda i: F.struct(
        F.lit("put").alias("contract_type"), i.alias("position"),
        F.round((below - i + 1) * step, 6).alias("strike_price"))) if n_puts else None
    parts = [p for p in (calls, puts) if p is not None]
    return F.concat(*parts)


def moneyness(spot: Column, strike: Column) -> Column:
    return F.when(strike > 0, spot / F.nullif(strike, F.lit(0.0)))


def log_moneyness(spot: Column, strike: Column) -> Column:
    return F.when((strike > 0) & (spot > 0), F.ln(ratio(spot, strike)))


def is_0dte(tte: Column) -> Column:
    return (tte < 1).cast("int")


def call_flag(flag: Column) -> Column:
    return (flag == "c").cast("int")
