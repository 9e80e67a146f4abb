"""The shared kernels against brute force, with hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.functions import indicators as ind
from tickframe.functions import pricing
from tickframe.operators import metrics, scanners
from tickframe.operators.asof import asof_bars, asof_grid, asof_join
from tickframe.operators.balance import undersample_majority
from tickframe.operators.metrics import roc_auc, threshold_sweep
from tickframe.operators.monitoring import error_rate, stalls
from tickframe.operators.quality import dedup_last
from tickframe.operators.quantiles import exact_quantiles
from tickframe.operators.ranking import global_position
from tickframe.operators.risk import equal_width_histogram

RNG = np.random.default_rng(7)
DAY0 = 1_704_067_200_000


def _days(n, days=2):
    ts = DAY0 + RNG.integers(0, days * 86_400_000, n)
    return ts, [str(d)[:10] for d in pd.to_datetime(ts, unit="ms")]


def _reference_asof(left, right, tolerance=None):
    parts = []
    for day, l in left.groupby("trade_date"):
        r = right[right.trade_date == day].sort_values(["ts_ms", "v"])
        parts.append(pd.merge_asof(l.sort_values("ts_ms"), r[["ts_ms", "v"]], on="ts_ms", tolerance=tolerance))
    return pd.concat(parts)


def _same(got, want, keys, col):
    a = got.sort_values(keys).reset_index(drop=True)[col].astype(float)
    b = want.sort_values(keys).reset_index(drop=True)[col].astype(float)
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("tolerance", [None, 600_000])
@pytest.mark.parametrize("slice_width", [None, 3_600_000, 60_000])
def test_asof_join_with_hot_time_and_ties(spark, tolerance, slice_width):
    lt, ld = _days(600)
    lt[:200], ld[:200] = lt[0], [ld[0]] * 200  # a third of the left rows share one timestamp
    rt, rd = _days(80)
    rt[:20], rd[:20] = rt[0], [rd[0]] * 20  # equal right timestamps: the highest v wins
    left = pd.DataFrame({"id": range(600), "trade_date": ld, "ts_ms": lt})
    right = pd.DataFrame({"trade_date": rd, "ts_ms": rt, "v": RNG.permutation(80)})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), tolerance=tolerance, tie="v",
                    slice_width=slice_width).toPandas()
    assert len(got) == 600
    _same(got, _reference_asof(left, right, tolerance), ["id"], "v")


def test_asof_grid_and_bars(spark):
    grid = 60_000
    slots = DAY0 + RNG.choice(2 * 1440, 300, replace=False) * grid
    bars = pd.DataFrame({"ts_ms": slots, "v": RNG.permutation(300)})
    bars["trade_date"] = pd.to_datetime(bars.ts_ms, unit="ms").astype(str).str[:10]
    lt, ld = _days(500)
    left = pd.DataFrame({"id": range(500), "trade_date": ld, "ts_ms": lt})
    got = asof_grid(spark.createDataFrame(left), spark.createDataFrame(bars), grid).toPandas()
    _same(got, _reference_asof(left, bars), ["id"], "v")

    right = pd.DataFrame({"trade_date": ld, "ts_ms": lt, "v": RNG.permutation(500)})
    base = bars.rename(columns={"v": "id"})
    for tolerance in (None, 120_000):
        got = asof_bars(spark.createDataFrame(base), spark.createDataFrame(right), grid, tolerance=tolerance, tie="v").toPandas()
        _same(got, _reference_asof(base, right, tolerance), ["id"], "v")


def _series(n=60):
    close = 100 + RNG.normal(0, 1, n).cumsum()
    return pd.DataFrame({"ticker": "a", "trade_date": "2024-01-01", "ts_ms": DAY0 + np.arange(n) * 60_000, "close": close})


def test_indicators_match_recursive_definitions(spark):
    pdf, w = _series(), ind.series_window()
    df = spark.createDataFrame(pdf)
    out = ind.layered(df, ind.rsi("close", "rsi", w), ind.ema("close", 9, "ema", w),
                      ind.macd("close", "macd", "sig", "hist", w), ind.bollinger("close", "bb", w)).orderBy("ts_ms").toPandas()
    c = pdf.close
    step = c.diff()
    up = step.where(step > 0, 0.0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    down = (-step).where(step < 0, 0.0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    ema = lambda x, s: x.ewm(span=s, adjust=False, min_periods=s).mean()
    macd = ema(c, 12) - ema(c, 26)
    want = {"rsi": 100 - 100 / (1 + up / down), "ema": ema(c, 9), "macd": macd, "sig": ema(macd, 9),
            "hist": macd - ema(macd, 9), "bb_middle": c.rolling(20).mean(),
            "bb_upper": c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0)}
    for name, series in want.items():
        np.testing.assert_allclose(out[name].astype(float), series, rtol=1e-9, err_msg=name)
    assert not [x for x in out.columns if x.startswith("_")]


def test_rsi_without_losses_is_100(spark):
    pdf = _series(20).assign(close=np.arange(20.0) + 1)
    out = ind.layered(spark.createDataFrame(pdf), ind.rsi("close", "rsi", ind.series_window())).orderBy("ts_ms").toPandas()
    assert out.rsi.isna().sum() == 13 and (out.rsi.dropna() == 100).all()


def test_full_day_of_seconds_fits_a_double(spark):
    """A minute-bar day is far below the length at which the weights overflow."""
    pdf = _series(1440)
    out = ind.layered(spark.createDataFrame(pdf), ind.ema("close", 9, "e", ind.series_window())).orderBy("ts_ms").toPandas()
    np.testing.assert_allclose(out.e.astype(float), pdf.close.ewm(span=9, adjust=False, min_periods=9).mean(), rtol=1e-8)


def test_exact_quantiles_with_a_hot_value(spark):
    values = np.concatenate([RNG.normal(0, 50, 500), np.zeros(300), RNG.integers(-5, 5, 100)])
    pdf = pd.DataFrame({"g": RNG.integers(0, 3, 900), "x": values})
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", probs).toPandas().set_index("g")
    for name, q in probs.items():
        np.testing.assert_allclose(got[name].sort_index(), pdf.groupby("g").x.quantile(q), rtol=1e-9)
    one = exact_quantiles(spark.createDataFrame(pdf), [], "x", {"m": 0.5}).first()
    assert one["m"] == pytest.approx(np.median(values))


def test_exact_quantiles_over_overlapping_levels(spark):
    pdf = pd.DataFrame({"c": RNG.integers(0, 4, 400), "x": RNG.normal(10, 3, 400)})
    got = exact_quantiles(spark.createDataFrame(pdf), [], "x", {"m": 0.5}, ("c", 4), complement=True).toPandas()
    got = got.set_index("level").m
    for i in range(3):
        assert got[i] == pytest.approx(pdf[pdf.c > i].x.median())
    assert 3 not in got.index
    for i in range(4):
        assert got[4 + i] == pytest.approx(pdf[pdf.c <= i].x.median())


def test_global_position_is_one_total_order(spark):
    ts, _ = _days(500, 4)
    ts[:170] = ts[0]
    pdf = pd.DataFrame({"ts": ts, "k": RNG.permutation(500)})
    got = global_position(spark.createDataFrame(pdf), "ts", ["k"]).toPandas().sort_values(["ts", "k"])
    assert got.position.tolist() == list(range(500))


def test_undersample_is_balanced_reproducible_and_whole(spark):
    pdf = pd.DataFrame({"id": range(3000), "target": [1 if i % 10 == 0 else 0 for i in range(3000)]})
    df = spark.createDataFrame(pdf)
    once, again = (undersample_majority(df.repartition(n), ["id"]).toPandas() for n in (1, 5))
    assert once.target.value_counts().to_dict() == {0: 300, 1: 300}
    assert set(once.id) == set(again.id) and set(pdf[pdf.target == 1].id) <= set(once.id)
    assert undersample_majority(df.where("target = 1"), ["id"]).count() == 300
    even = df.where("id < 20").withColumn("target", F.col("id") % 2)
    assert undersample_majority(even, ["id"]).count() == 20


def test_dedup_with_hot_key_keeps_last_arrival(spark):
    pdf = pd.DataFrame({"k": [0] * 300 + list(range(1, 601)), "at": RNG.permutation(900)})
    got = dedup_last(spark.createDataFrame(pdf), ["k"], ["at"]).toPandas()
    assert got.set_index("k")["at"].to_dict() == pdf.groupby("k")["at"].max().to_dict()


def test_dedup_trims_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    assert "WindowGroupLimit" in dedup_last(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()


def test_roc_auc_counts_ties_half(spark):
    y, p = RNG.integers(0, 2, 300), np.round(RNG.random(300), 1)
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    got = roc_auc(spark.createDataFrame(pd.DataFrame({"target": y, "proba": p}))).first()["roc_auc"]
    assert got == pytest.approx(want)
    single = spark.createDataFrame([(1, 0.5)], "target int, proba double")
    assert roc_auc(single).first()["roc_auc"] is None


def test_sweep_invariants(spark):
    n = 400
    pdf = pd.DataFrame({"target": RNG.integers(0, 2, n), "proba": RNG.random(n), "date": "2024-01-02",
                        "max_gain_120m": RNG.normal(10, 5, n), "min_loss_120m": RNG.normal(-10, 5, n)})
    rows = threshold_sweep(spark.createDataFrame(pdf)).orderBy("threshold").toPandas()
    parts = rows[["true_positives", "false_positives", "false_negatives", "true_negatives"]]
    assert (parts.sum(axis=1) == n).all() and rows.total_signals.is_monotonic_decreasing and len(rows) == 26
    for r in rows.itertuples():
        tp = pdf[(pdf.proba >= r.threshold) & (pdf.target == 1)].max_gain_120m
        assert r.tp_profit_pct_count == len(tp) and r.tp_profit_pct_median == pytest.approx(tp.median())
        assert r.tp_profit_pct_std == pytest.approx(tp.std())


def test_sweep_single_and_empty_cells(spark):
    df = spark.createDataFrame([(1, 0.9, 12.0, -1.0)], "target int, proba double, max_gain_120m double, min_loss_120m double")
    rows = {round(r["threshold"], 2): r for r in threshold_sweep(df).collect()}
    assert rows[0.9]["tp_profit_pct_std"] == 0.0 and rows[0.95]["tp_profit_pct_std"] is None
    assert rows[0.95]["precision"] == 0.0 and rows[0.95]["expected_value_pct"] == 0.0


def test_error_rate_slices_equal_one_window(spark):
    ts = np.sort(DAY0 + RNG.integers(0, 10_000_000, 400))
    df = spark.createDataFrame(pd.DataFrame({"ts_ms": ts, "is_error": RNG.random(400) > 0.7}))
    got = error_rate(df, window_ms=900_000, slice_ms=100_000)
    w = Window.orderBy("ts_ms").rangeBetween(-900_000, 0)
    want = df.select("ts_ms", F.count("*").over(w).alias("total"),
                     F.sum(F.col("is_error").cast("int")).over(w).alias("errors")).distinct()
    assert got.select("ts_ms", "total", "errors").exceptAll(want).count() == 0 and got.count() == want.count()


def test_stalls_find_every_long_gap(spark):
    ts = [0, 1_000, 899_999, 1_900_000, 1_900_001, 2_799_999, 3_800_000]
    df = spark.createDataFrame([("a", t) for t in ts], "k string, ts_ms long")
    got = {(r["stalled_from_ms"], r["resumed_ms"]) for r in stalls(df, ["k"]).collect()}
    assert got == {(899_999, 1_900_000), (2_799_999, 3_800_000)}


def test_histogram_matches_numpy(spark):
    x = RNG.normal(0, 1, 500)
    got = equal_width_histogram(spark.createDataFrame(pd.DataFrame({"x": x})), "x").orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=10)
    assert got.n.tolist() == counts.tolist()
    np.testing.assert_allclose(got.left_edge, edges[:-1])


def test_pricing_bounds_and_round_trip(spark):
    df = spark.createDataFrame([(v, call) for v in (0.05, 0.2, 0.8, 2.0) for call in (True, False)], "v double, call boolean")
    s, k, t = F.lit(100.0), F.lit(105.0), F.lit(30 / 365)
    out = df.withColumn("p", pricing.bs_price(s, k, t, F.col("v"), F.col("call")))
    out = out.withColumn("iv", pricing.implied_vol(F.col("p"), s, k, F.lit(30.0), F.col("call")))
    for r in out.collect():
        assert r["iv"] == pytest.approx(r["v"], abs=1e-4)
    g = {n: e for n, e in pricing.greek_columns(s, k, t, F.lit(0.3), F.col("call")).items()}
    for r in df.select("call", *[e.alias(n) for n, e in g.items()]).collect():
        assert (0 < r["delta"] < 1) if r["call"] else (-1 < r["delta"] < 0)
        assert r["gamma"] > 0 and r["vega"] > 0 and r["theta"] < 0
    bad = spark.createDataFrame([(0.0, 100.0, 10.0), (200.0, 100.0, 10.0), (1.0, -1.0, 10.0), (1.0, 100.0, 0.0)], "p double, s double, d double")
    ivs = bad.select(pricing.implied_vol(F.col("p"), F.col("s"), k, F.col("d"), F.lit(True)).alias("iv")).collect()
    assert [r["iv"] for r in ivs] == [0.2] * 4


def _plain_backward(close, window, up=1.2, hold=1.1):
    floor, bar, out = 0, 0, []
    while bar < len(close):
        begin = max(floor, bar - window)
        past = [c for c in close[begin:bar] if c is not None]
        low = min(past, default=0.0)
        if low > 0 and close[bar] is not None and close[bar] >= low * up:
            stop = next((k + 1 for k in range(bar, len(close)) if close[k] is None or close[k] < low * hold), len(close))
            run = [c for c in close[bar:stop] if c is not None]
            out.append((begin + close[begin:bar].index(low), bar, sum(c >= low * up for c in run), sum(c >= low * hold for c in run)))
            floor = bar = stop
        else:
            bar += 1
    return out


def _plain_forward(close, window, up=1.2, hold=1.1):
    bar, out = 0, []
    while bar < len(close):
        entry = close[bar]
        hit = next((k for k in range(bar + 1, min(bar + 1 + window, len(close))) if close[k] is not None and close[k] >= entry * up), None) if entry else None
        if hit is None:
            bar += 1
            continue
        stop = next((k + 1 for k in range(hit, len(close)) if close[k] is None or close[k] < entry * hold), len(close))
        run = [c for c in close[hit:stop] if c is not None]
        out.append((bar, hit, sum(c >= entry * up for c in run), sum(c >= entry * hold for c in run)))
        bar = stop
    return out


def test_scans_match_a_plain_loop(spark):
    rng, rows, days = np.random.default_rng(8), [], {}
    for d in range(30):
        n = int(rng.integers(1, 300)) if d else 23_400  # the first is a day of second bars
        price = 10 * np.exp(np.cumsum(rng.normal(0, 0.002 if d == 0 else 0.08, n)))
        close = [None if rng.random() < 0.03 else 0.0 if rng.random() < 0.01 else float(p) for p in price]
        days[f"t{d}"] = close
        rows += [(f"t{d}", "2024-03-04", DAY0 + 1000 * k, c) for k, c in enumerate(close)]
    df = spark.createDataFrame(rows, "ticker string, trade_date string, ts_ms long, close double").repartition(4)
    for find, plain in ((scanners._backward_event, _plain_backward), (scanners._forward_event, _plain_forward)):
        got = scanners._scan(df, find, 120, 20.0, 10.0, "ts_ms")
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["ticker"], (r["anchor_ms"] - DAY0) // 1000, (r["trigger_ms"] - DAY0) // 1000, r["above_trigger"], r["above_sustain"]) for r in got.collect())
        want = sorted((t, *e) for t, close in days.items() for e in plain(close, 120))
        assert found == want and len(found) > 100


def test_packed_scores_are_split(spark):
    rng = np.random.default_rng(4)
    packed = np.unique(0.5 + rng.random(60_000) * 1e-9)
    score = np.concatenate([packed, [0.0, 1.0, 0.0, 1.0], rng.random(500), np.repeat(packed[:50], 3)])
    y = (rng.random(len(score)) < 0.3 + 0.4 * (score > np.median(score))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"proba": score, "target": y}))
    ranks = pd.Series(score).rank().to_numpy()
    n1, n0 = y.sum(), len(y) - y.sum()
    want = (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(want, abs=1e-12)
    # a million different scores within 1e-6: no band of any level holds more than its share
    dense = spark.range(1_000_000).select(metrics.score_cell(0.5 + F.col("id") / 1e12).alias("c"))
    for shift in (15, 30, 45):
        sizes = dense.select(F.shiftright("c", shift - 15).alias("c")).distinct().groupBy(F.shiftright("c", 15)).count()
        assert sizes.agg(F.max("count")).head()[0] <= 1 << 15
    with pytest.raises(Exception, match="not a score"):
        metrics.roc_auc(spark.createDataFrame([(1.5, 1), (0.2, 0)], "proba double, target int")).collect()


def test_quantiles_of_counted_rows_are_those_of_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(str(g), int(c), float(v), int(n)) for g, c, v, n in zip(
        rng.integers(0, 3, 200), rng.integers(0, 4, 200), rng.integers(-30, 30, 200) / 4, rng.integers(1, 40, 200))]
    rows += [("hot", 1, 2.5, 50_000), ("hot", 2, 3.5, 50_001), ("hot", 0, None, 7)]
    counted = spark.createDataFrame(rows, "g string, c int, v double, n long")
    single = counted.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("_", "n")
    probs = {"q1": 0.25, "m": 0.5, "q9": 0.9}
    for levels in (None, ("c", 3)):
        names = ["g", *(["level"] if levels else []), *probs]
        got = sorted(map(tuple, exact_quantiles(counted, ["g"], "v", probs, levels, weight="n").select(names).collect()))
        assert got == sorted(map(tuple, exact_quantiles(single, ["g"], "v", probs, levels).select(names).collect()))
        if not levels:
            for g, *values in got:
                every = np.concatenate([np.full(n, v) for h, _, v, n in rows if h == g and v is not None])
                assert np.allclose(values, np.quantile(every, list(probs.values())))
