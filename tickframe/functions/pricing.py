"""Black-Scholes measures.

The normal distribution uses the rational approximation 26.2.17 of Abramowitz
and Stegun (absolute error below 7.5e-8), so columns stay inside the JVM and the
same formula can be written in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import let, ratio

# Approximation constants and pricing defaults.
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
RISK_FREE = 0.045
IV_LOW = 0.01
IV_HIGH = 5.0
IV_FALLBACK = 0.20
IV_STEPS = 60
IV_CLOSE = 1e-13
YEAR_DAYS = 365.0
MIN_TTE_DAYS = 0.01


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / sqrt(2 * pi)


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + AS_P * F.abs(x))
    poly = F.lit(AS_B[4])
    for b in reversed(AS_B[:4]):
        poly = poly * t + b
    tail = normal_pdf(x) * poly * t
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _d1_d2(s: Column, k: Column, t: Column, v: Column, r: float) -> tuple[Column, Column]:
    spread = v * F.sqrt(t)
    d1 = (F.ln(s / k) + (r + v * v / 2) * t) / spread
    return d1, d1 - spread


def bs_price(s: Column, k: Column, t: Column, v: Column, call: Column, r: float = RISK_FREE) -> Column:
    d1, d2 = _d1_d2(s, k, t, v, r)
    w = F.when(call, 1.0).otherwise(-1.0)
    return w * (s * normal_cdf(w * d1) - k * F.exp(-r * t) * normal_cdf(w * d2))


def greek_columns(s: Column, k: Column, t: Column, v: Column, call: Column,
                  r: float = RISK_FREE) -> dict[str, Column]:
    """Delta, gamma, theta per day, vega and rho per percentage point."""
    d1, d2 = _d1_d2(s, k, t, v, r)
    disc = k * F.exp(-r * t)
    density = normal_pdf(d1)
    w = F.when(call, 1.0).otherwise(-1.0)
    return {
        "delta": w * normal_cdf(w * d1),
        "gamma": density / (s * v * F.sqrt(t)),
        "theta": (-s * density * v / (2 * F.sqrt(t)) - w * r * disc * normal_cdf(w * d2)) / YEAR_DAYS,
        "vega": s * density * F.sqrt(t) / 100,
        "rho": w * t * disc * normal_cdf(w * d2) / 100,
    }


def _let_cdf(x: Column) -> Column:
    """``normal_cdf`` of an expression that is worked out once."""
    def tail(x: Column) -> Column:
        return let(1 / (1 + AS_P * F.abs(x)), lambda t: normal_pdf(x) * t * reduce(lambda a, b: a * t + b, reversed(AS_B[:4]), F.lit(AS_B[4])))
    return let(x, lambda x: let(tail(x), lambda y: F.when(x >= 0, 1 - y).otherwise(y)))


def implied_vol(price: Column, spot: Column, strike: Column, tte_days: Column, call: Column,
                rate: float = RISK_FREE) -> Column:
    """Implied volatility, or the fallback for unusable inputs and no solution in range.

    Newton steps from the point of inflection, from which they close in on one side, inside a bracket that is
    halved where a step would leave it.  The steps are a fold inside the JVM that stands still once the root
    is found; rows with unusable inputs or a price outside of the range's never reach it.
    """
    usable = (price > 0) & (spot > 0) & (strike > 0) & (tte_days > 0)
    years = tte_days / YEAR_DAYS
    quote = F.struct(price.cast("double").alias("p"), spot.cast("double").alias("s"), years.alias("t"), F.sqrt(years).alias("root"),
                     F.ln(spot / strike).alias("m"), (strike * F.exp(-rate * years)).alias("k"), F.when(call, 1.0).otherwise(-1.0).alias("w"))

    def at(q: Column, v: Column, body: Callable[[Column], Column]) -> Column:
        return let((q["m"] + (rate + v * v / 2) * q["t"]) / (v * q["root"]), body)

    def value(q: Column, v: Column, d: Column) -> Column:
        return q["w"] * (q["s"] * _let_cdf(q["w"] * d) - q["k"] * _let_cdf(q["w"] * (d - v * q["root"])))

    def step(q: Column, b: Column) -> Column:
        x = b["x"]
        probed = at(q, x, lambda d: F.struct((value(q, x, d) - q["p"]).alias("over"), (q["s"] * normal_pdf(d) * q["root"]).alias("slope")))
        low = lambda f: F.when(f["over"] < 0, x).otherwise(b["low"])
        high = lambda f: F.when(f["over"] < 0, b["high"]).otherwise(x)
        return let(probed, lambda f: let(
            F.struct(low(f).alias("low"), high(f).alias("high"), (x - ratio(f["over"], f["slope"])).alias("x")),
            lambda n: let(F.when((n["x"] > n["low"]) & (n["x"] < n["high"]), n["x"]).otherwise((n["low"] + n["high"]) / 2), lambda y: F.struct(
                n["low"].alias("low"), n["high"].alias("high"), y.alias("x"), (F.abs(y - x) < IV_CLOSE).alias("found")))))

    def solved(q: Column) -> Column:
        inside = (at(q, F.lit(IV_LOW), lambda d: value(q, F.lit(IV_LOW), d)) <= q["p"]) & (
            q["p"] <= at(q, F.lit(IV_HIGH), lambda d: value(q, F.lit(IV_HIGH), d)))
        inflection = F.sqrt(2 * F.abs(q["m"] + rate * q["t"]) / q["t"])
        start = F.struct(F.lit(IV_LOW).alias("low"), F.lit(IV_HIGH).alias("high"),
                         F.greatest(F.lit(IV_LOW), F.least(F.lit(IV_HIGH), inflection)).alias("x"), F.lit(False).alias("found"))
        root = F.aggregate(F.sequence(F.lit(1), F.lit(IV_STEPS)), start, lambda b, _: F.when(b["found"], b).otherwise(step(q, b)), lambda b: b["x"])
        return F.when(inside, root)

    return F.coalesce(F.when(usable, let(quote, solved)), F.lit(IV_FALLBACK))


def add_greeks(df: DataFrame, spot: str = "spy_close", price: str = "option_avg_price",
               rate: float = RISK_FREE) -> DataFrame:
    """Greeks and IV for rows with a ticker, strike, spot and at least 0.01 days left; else NULL."""
    ok = (F.col("ticker").isNotNull() & F.col("strike_price").isNotNull() & F.col(spot).isNotNull()
          & (F.col("time_to_expiry_days") >= MIN_TTE_DAYS))
    call = F.col("contract_type").isin("call", "c")
    vol = implied_vol(F.col(price), F.col(spot), F.col("strike_price"),
                      F.col("time_to_expiry_days"), call, rate)
    priced = ok & (F.col(spot) > 0) & (F.col("strike_price") > 0)
    greeks = greek_columns(F.col(spot), F.col("strike_price"), F.col("time_to_expiry_days") / YEAR_DAYS,
                           F.col("implied_volatility"), call, rate)
    return (df.withColumn("implied_volatility", F.when(ok, vol))
            .withColumns({name: F.when(priced, expr) for name, expr in greeks.items()}))
