"""Window features over one instrument-day.

Every function expects bars on a time grid, so a (ticker, trade_date) partition
holds at most one row per grid step (1,440 for minute bars) however large the
table is.  Exponential averages are running sums within blocks of rows plus a
carry from the few earlier blocks that still count, so series of any length are exact.

A feature is a list of layers: dictionaries of columns, each layer using the
columns of the ones before it.  ``layered`` adds several features layer by
layer, so window functions of the same depth share one sort and one pass.
Columns starting with an underscore are dropped at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .numeric import log_pct, pct_from, ratio, rows, warm

SERIES = ("ticker", "trade_date")
Layers = list[dict[str, Column]]

# Indicator periods.
RSI_PERIOD = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BB_PERIOD, BB_WIDTH = 20, 2.0
EWM_BLOCK = 256


def series_window(by: Sequence[str] = SERIES, ts: str = "ts_ms") -> WindowSpec:
    """Rows of a series in time order; keeps its key and order for windows over parts of a series."""
    w = Window.partitionBy(*by).orderBy(ts)
    w.series = (tuple(by), ts)
    return w


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def onward(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.currentRow, Window.unboundedFollowing)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def layered(df: DataFrame, *features: Layers) -> DataFrame:
    """Add features, one projection per layer."""
    helpers: list[str] = []
    for depth in range(max(len(f) for f in features)):
        layer: dict[str, Column] = {}
        for f in features:
            if depth < len(f):
                layer.update(f[depth])
        helpers += [c for c in layer if c.startswith("_") and c not in helpers]
        df = df.withColumns(layer)
    return df.drop(*helpers)


def beside(*features: Layers) -> Layers:
    """Features computed side by side."""
    out: Layers = [{} for _ in range(max(len(f) for f in features))]
    for f in features:
        for depth, layer in enumerate(f):
            out[depth].update(layer)
    return out


def after(first: Layers, second: Layers) -> Layers:
    """``second`` on top of the columns of ``first``."""
    return [*first, *second]


def ewm(source: Column, name: str, alpha: float, w: WindowSpec, min_periods: int) -> Layers:
    """Exponential mean seeded with the first non-NULL input, NULL for the first inputs.

    NULLs may lead the series but not interrupt it.  Weights (1-a)^-j restart in
    every block of 256 rows, which keeps them inside a double.  A block's value is
    carried on with (1-a)^256 per block; blocks whose weight is below 2^-60 are beyond
    the precision of a double and left out.  ``w`` comes from ``series_window``.
    """
    if not 0 < alpha <= 0.9:
        raise ValueError("alpha must be in (0, 0.9]")
    by, ts = w.series
    x, i, wx, r, end, carry = (f"_{name}_{c}" for c in ("x", "i", "wx", "r", "end", "carry"))
    keep, j = 1 - alpha, F.col("_ewm_place").cast("double")
    blocks = math.ceil(60 / (EWM_BLOCK * -math.log2(keep))) + 1
    in_block = running(Window.partitionBy(*by, "_ewm_block").orderBy(ts))
    first_weight = F.when(F.col(i) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    ends = sum((F.coalesce(F.lag(r, k * EWM_BLOCK).over(w), F.lit(0.0)) * F.lit(keep ** (k * EWM_BLOCK)) for k in range(1, blocks)), F.col(r))
    at = F.row_number().over(w) - 1
    return [
        {x: source},
        {i: F.count(x).over(running(w)) - 1, "_ewm_block": F.floor(at / EWM_BLOCK), "_ewm_place": F.pmod(at, F.lit(EWM_BLOCK))},
        {wx: F.when(F.col(x).isNotNull(), F.col(x) * first_weight * F.pow(F.lit(keep), -j))},
        {r: F.pow(F.lit(keep), j) * F.coalesce(F.sum(wx).over(in_block), F.lit(0.0))},
        {end: F.when(F.col("_ewm_place") == EWM_BLOCK - 1, ends)},
        {carry: F.last(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))},
        {name: F.when(F.col(i) + 1 >= min_periods, F.col(r) + F.pow(F.lit(keep), j + 1) * F.coalesce(carry, F.lit(0.0)))},
    ]


def ema(close: str, span: int, name: str, w: WindowSpec) -> Layers:
    return ewm(F.col(close), name, 2.0 / (span + 1), w, span)


def rsi(close: str, name: str, w: WindowSpec, period: int = RSI_PERIOD) -> Layers:
    """Wilder RSI: exponential means of gains and losses, 100 when there is no loss."""
    step, up, down = f"_{name}_step", f"_{name}_up", f"_{name}_down"
    gain = F.when(F.col(step) > 0, F.col(step)).otherwise(F.lit(0.0))
    loss = F.when(F.col(step) < 0, -F.col(step)).otherwise(F.lit(0.0))
    value = F.when(F.col(down) == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + ratio(F.col(up), F.col(down))))
    means = beside(ewm(gain, up, 1.0 / period, w, period), ewm(loss, down, 1.0 / period, w, period))
    return [{step: F.col(close) - F.lag(close).over(w)}, *means, {name: F.when(F.col(down).isNotNull(), value)}]


def macd(close: str, line: str, signal: str, hist: str, w: WindowSpec,
         fast: int = MACD_FAST, slow: int = MACD_SLOW, sign: int = MACD_SIGNAL) -> Layers:
    f, s = f"_{line}_fast", f"_{line}_slow"
    both = beside(ema(close, fast, f, w), ema(close, slow, s, w))
    return [*both, {line: F.col(f) - F.col(s)}, *ewm(F.col(line), signal, 2.0 / (sign + 1), w, sign),
            {hist: F.col(line) - F.col(signal)}]


def bollinger(close: str, prefix: str, w: WindowSpec, period: int = BB_PERIOD, width: float = BB_WIDTH) -> Layers:
    """{prefix}_upper/_middle/_lower/_width/_pct_b with the population deviation."""
    frame = rows(w, period)
    full = F.count(close).over(frame) >= period
    mid, up, low, sd = (f"{prefix}_middle", f"{prefix}_upper", f"{prefix}_lower", f"_{prefix}_sd")
    return [
        {mid: F.when(full, F.avg(close).over(frame)), sd: F.when(full, F.stddev_pop(close).over(frame))},
        {up: F.col(mid) + F.lit(width) * F.col(sd), low: F.col(mid) - F.lit(width) * F.col(sd)},
        {f"{prefix}_width": ratio(F.col(up) - F.col(low), F.col(mid)) * 100,
         f"{prefix}_pct_b": ratio(F.col(close) - F.col(low), F.col(up) - F.col(low))},
    ]


def blank_short(cols: Sequence[str], min_bars: int, w: WindowSpec) -> Layers:
    """NULL the columns of every series with fewer than ``min_bars`` bars."""
    n = F.count(F.lit(1)).over(whole(w))
    return [{"_bars": n}, {c: F.when(F.col("_bars") >= min_bars, F.col(c)) for c in cols}]


def momentum(close: str, windows: Sequence[int], w: WindowSpec, prefix: str = "") -> Layers:
    """Difference and fractional change against n rows earlier."""
    out: dict[str, Column] = {}
    for n in windows:
        past = F.lag(close, n).over(w)
        out[f"{prefix}price_change_{n}"] = F.col(close) - past
        out[f"{prefix}roc_{n}"] = ratio(F.col(close) - past, past)
    return [out]


def lag_change(col: str, name: str, windows: Sequence[int], w: WindowSpec,
               gate: str = "minutes_since_open") -> Layers:
    """{name}_{n}m: percent change against n rows earlier, 0.0 before minute n."""
    return [{f"{name}_{n}m": warm(pct_from(F.col(col), F.lag(col, n).over(w)), F.col(gate), n) for n in windows}]


def log_return(col: str, name: str, windows: Sequence[int], w: WindowSpec,
               gate: str = "minutes_since_open") -> Layers:
    """{name}_{n}m: log return in percent, 0.0 before minute n."""
    return [{f"{name}_{n}m": warm(log_pct(F.col(col), F.lag(col, n).over(w)), F.col(gate), n) for n in windows}]


def change_from_first(col: str, w: WindowSpec) -> Column:
    """Percent change against the first bar; NULL when that bar is NULL or not positive."""
    first = F.first_value(F.col(col)).over(running(w))
    return F.when(first > 0, pct_from(F.col(col), first))


def rolling_mean(col: str, n: int, mean: str, w: WindowSpec, rel: str | None = None) -> Layers:
    """Mean of the last n rows and, as ``rel``, the value relative to it."""
    out: Layers = [{mean: F.avg(col).over(rows(w, n))}]
    return [*out, {rel: ratio(F.col(col).cast("double"), F.col(mean))}] if rel else out


def rolling_zscore(col: str, n: int, min_periods: int, w: WindowSpec) -> Column:
    frame = rows(w, n)
    sd = F.when(F.count(col).over(frame) >= min_periods, F.stddev_samp(col).over(frame))
    return ratio(F.col(col) - F.avg(col).over(frame), sd)


def return_volatility(close: str, windows: dict[int, str], w: WindowSpec) -> Layers:
    """Sample deviation of one-row log returns in percent, at least two returns."""
    ret = f"_{close}_ret"
    sd = lambda f: F.when(F.count(ret).over(f) >= 2, F.stddev_samp(ret).over(f))
    return [{ret: log_pct(F.col(close), F.lag(close).over(w))},
            {name: sd(rows(w, n)) for n, name in windows.items()}]


def hl_range(high: str, low: str, close: str, n: int, w: WindowSpec) -> Column:
    frame = rows(w, n)
    return ratio(F.max(high).over(frame) - F.min(low).over(frame), F.col(close)) * 100


def fill_both_ways(cols: Sequence[str], w: WindowSpec) -> Layers:
    """Forward then backward fill inside the day.  Leaky: warm-up rows see later bars."""
    return [{c: F.coalesce(F.last(c, ignorenulls=True).over(running(w)),
                           F.first(c, ignorenulls=True).over(onward(w))) for c in cols}]


def cumulative_share(col: str, w: WindowSpec) -> Column:
    """Running sum over the day's total.  Leaky: the total includes later bars."""
    total = F.sum(col).over(whole(w))
    return F.when(total > 0, F.sum(col).over(running(w)) / total)


def bar_counter(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def plain_change(col: str, n: int, w: WindowSpec) -> Column:
    """Ungated percent change against n rows earlier."""
    return pct_from(F.col(col), F.lag(col, n).over(w))
