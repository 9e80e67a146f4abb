"""The pricing formulas as SQL text, shared by the checks of G1, G2 and the jobs."""

from __future__ import annotations

from ..functions.pricing import AS_B, AS_P, IV_STEPS, RISK_FREE


def cdf(x: str) -> str:
    """Normal distribution of a column (26.2.17)."""
    t = f"(1 / (1 + {AS_P}::DOUBLE * abs({x})))"
    poly = f"{AS_B[4]}::DOUBLE"
    for b in reversed(AS_B[:4]):
        poly = f"({poly} * {t} + ({b})::DOUBLE)"
    tail = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {poly} * {t})"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def priced(src: str, vol: str, out: str) -> str:
    """``src`` (s, k, t, w) with the option value at volatility ``vol`` as ``out``."""
    return f"""SELECT * EXCLUDE (_d1, _x1, _x2), w * (s * ({cdf("_x1")}) - k * exp(-{RISK_FREE} * t) * ({cdf("_x2")})) AS {out}
        FROM (SELECT *, w * _d1 AS _x1, w * (_d1 - {vol} * sqrt(t)) AS _x2 FROM (
        SELECT *, (ln(s / k) + ({RISK_FREE} + {vol} * {vol} / 2) * t) / ({vol} * sqrt(t)) AS _d1 FROM {src}))"""


def iv_chain(src: str) -> str:
    """Recursive bisection over ``src`` (id, p, s, k, t, w)."""
    low = priced(src, "0.01::DOUBLE", "_pl")
    both = priced(f"({low})", "5.0::DOUBLE", "_ph")
    step = priced("(SELECT *, (lo + hi) / 2 AS mid FROM chain_iv WHERE step < %d)" % IV_STEPS, "mid", "v")
    return f"""SELECT id, p, s, k, t, w, 0 AS step, 0.01::DOUBLE AS lo, 5.0::DOUBLE AS hi, _pl <= p AND p <= _ph AS inside FROM ({both})
        UNION ALL SELECT id, p, s, k, t, w, step + 1, CASE WHEN v < p THEN mid ELSE lo END, CASE WHEN v < p THEN hi ELSE mid END, inside
        FROM ({step})"""


IV_RESULT = f"SELECT id, CASE WHEN inside THEN (lo + hi) / 2 ELSE 0.20 END AS iv FROM chain_iv WHERE step = {IV_STEPS}"


def greeks(src: str, vol: str) -> str:
    """``src`` (s, k, t, w) with the five measures."""
    return f"""SELECT * EXCLUDE (_d1, _d2, _x1, _x2, _n1), w * ({cdf("_x1")}) AS delta, _n1 / (s * {vol} * sqrt(t)) AS gamma,
        (-s * _n1 * {vol} / (2 * sqrt(t)) - w * {RISK_FREE} * k * exp(-{RISK_FREE} * t) * ({cdf("_x2")})) / 365 AS theta,
        s * _n1 * sqrt(t) / 100 AS vega, w * t * k * exp(-{RISK_FREE} * t) * ({cdf("_x2")}) / 100 AS rho
        FROM (SELECT *, w * _d1 AS _x1, w * _d2 AS _x2, exp(-_d1 * _d1 / 2) / sqrt(2 * pi()) AS _n1 FROM (
        SELECT *, _d1 - {vol} * sqrt(t) AS _d2 FROM (
        SELECT *, (ln(s / k) + ({RISK_FREE} + {vol} * {vol} / 2) * t) / ({vol} * sqrt(t)) AS _d1 FROM {src})))"""
