"""Findings of round 3: zero prices, hot classes, trailing windows, fits over all passages."""

import duckdb
import pytest
from harness import connect, differences
from pyspark.sql import functions as F

from tickframe.catalog import everything
from tickframe.operators import balance, explain, metrics, monitoring, quality, ranking, splits
from tickframe.session import materialise


@pytest.fixture(scope="module")
def zero_sf(sf, tmp_path_factory):
    """The smallest events with a value of 0 in every seventh."""
    path = str(tmp_path_factory.mktemp("zero"))
    duckdb.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS value) FROM '{sf}/events.parquet')
        TO '{path}/events.parquet' (FORMAT parquet)""")
    return path


@pytest.mark.parametrize("key", ["C6_backfill", "C6_backfill_ledger", "R12_ingest_stats", "R1_stream_ingest", "R2_stream_ingest_options"])
def test_events_of_value_zero_are_kept(spark, zero_sf, key):
    query = everything()[key]
    assert differences(query.run(spark, zero_sf), connect(zero_sf), query.oracle()) == []


def test_zero_is_a_price_only_where_allowed(spark):
    df = spark.createDataFrame([(1, 0.0, -1.0, 5.0, 5.0, 0, 5.0, "spy")],
                               "timestamp long, open double, high double, low double, close double, volume long, vwap double, source string")
    assert quality.validate(df, "spy").first()["errors"] == ["not_positive:high", "not_positive:open", "not_positive:volume"]
    assert quality.validate(df, quality.zero_allowed("spy")).first()["errors"] == ["not_positive:volume", "negative:high"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big_estimate(spark):
    """Sides of unknown size are planned as they are over large tables: not small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000b")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_class_or_day_meets_in_one_task(spark, big_estimate):
    df = spark.range(40_000).select("id", (F.col("id") % 9 == 0).cast("int").alias("target"),
                                    F.format_string("2024-01-%02d", F.col("id") % 28 + 1).alias("date"))
    df = materialise(df)
    assert "SortMergeJoin" not in _plan(balance.undersample_majority(df, ["id"]))
    assert "SortMergeJoin" not in _plan(balance.attach_class_weight(df, balance.class_weights(df)))
    assert "SortMergeJoin" not in _plan(splits.chronological_split(df))
    assert "SortMergeJoin" not in _plan(splits.fit_val_split(df))
    assert "SortMergeJoin" not in _plan(ranking.global_position(df, "date", ["id"]))


def test_a_trailing_window_is_a_running_sum(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 4000).alias("ts_ms"), (F.col("id") % 3 == 0).alias("is_error"))
    got = monitoring.error_rate(df, window_ms=900, slice_ms=500)
    assert "-900" not in _plan(got) and "unboundedpreceding" in _plan(got)
    rows = [(r[0] * 7 % 4000, r[0] % 3 == 0) for r in spark.range(5000).collect()]
    want = {t: (sum(t - 900 <= s <= t for s, _ in rows), sum(e for s, e in rows if t - 900 <= s <= t)) for t in range(0, 4000, 97)}
    assert {r["ts_ms"]: (r["total"], r["errors"]) for r in got.collect() if r["ts_ms"] in want} == want


def test_the_latent_space_is_fitted_on_all_passages(spark):
    import numpy as np
    from tickframe.llm import decontaminate as dec
    names, n = [f"w{k}x" for k in range(40)], 24_000
    held = lambda i: sorted({(i * (k + 3) + k * k) % 40 for k in range(2 + i % 5)})
    docs = spark.createDataFrame([(i, " ".join(names[k] for k in held(i))) for i in range(n)], "doc_id long, text string").repartition(11)
    bench = spark.createDataFrame([(k, " ".join(names[k * 10:k * 10 + 10])) for k in range(4)], "item_id long, text string")
    found, _ = dec.read_items(bench, "item_id", "text", None)
    terms, space, _ = dec.fit(docs, found, 8, 7)
    place = {int(h): k for k, h in enumerate(terms.hashes)}
    at = {names[item * 10 + j]: place[int(h)] for item, (_, hashes) in enumerate(found) for j, h in enumerate(hashes)}
    a = np.zeros((n, 40))
    for i in range(n):
        a[i, [at[names[k]] for k in held(i)]] = 1
    weight = np.log((n + 1) / (a.sum(axis=0) + 1))
    items = np.zeros((4, 40))
    for k, (_, h) in enumerate(found):
        items[k, [place[int(x)] for x in h]] = 1
    a, items = a * weight, items * weight
    probe = np.random.default_rng(7).standard_normal((40, 8))
    z, own = a.T @ (a @ probe), items.T @ (items @ probe)
    basis, _ = np.linalg.qr(z / np.linalg.norm(z) + own / np.linalg.norm(own))
    assert np.allclose(space, weight[:, None] * basis, atol=1e-4)


_SIGNALS = [(1, 0.9, 0.1, -0.3, 0.2), (1, 0.8, -0.3, None, 0.3), (2, 0.71, -0.2, 0.2, -0.2), (3, 0.5, None, None, float("nan")), (4, 0.6, None, 0.0, None),
            *[(5, 0.7, -0.1, -0.2, -0.3)] * 5]


def _signals(spark):
    return spark.createDataFrame(_SIGNALS, "id long, proba double, f double, g double, h double")


def _map_sides(plan: str) -> list[str]:
    """What lies below each exchange by hash, down to the leaves."""
    return plan.split("Exchange hashpartitioning")[1:]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_the_strongest_impacts_are_those_of_the_window_over_all(spark, k):
    got = explain.top_impacts(_signals(spark), ["id"], ["f", "g", "h"], k)
    rows = [(i, name, x) for i, _, *v in _SIGNALS for name, x in zip("fgh", v)]
    size = lambda r: (r[2] is None, -1e9 if r[2] is not None and r[2] != r[2] else -abs(r[2] or 0), r[1])
    want = {i: [(n, r[1], None if r[2] is None else str(abs(r[2]))) for n, r in enumerate(sorted([r for r in rows if r[0] == i], key=size)[:k], 1)]
            for i in range(1, 6)}
    found = {i: sorted((r["rank"], r["feature"], None if r["impact"] is None else str(abs(r["impact"]))) for r in got.where(f"id = {i}").collect())
             for i in range(1, 6)}
    assert found == want


def test_a_signal_is_shuffled_once_and_not_sorted_or_spread_before(spark, big_estimate):
    for df in (explain.top_impacts(_signals(spark), ["id"], ["f", "g", "h"], 2), explain.signal_cautions(_signals(spark), ["id"], ["f", "g", "h"], 0.7)):
        below = _map_sides(_plan(df))
        assert len(below) == 1 and not any(step in below[0] for step in ("Sort", "Generate", "WindowGroupLimit"))


def test_cautions_count_all_rows_of_a_signal(spark):
    got = {r["id"]: (r["risk_factors"], r["caution"]) for r in explain.signal_cautions(_signals(spark), ["id"], ["f", "g", "h"], 0.7).collect()}
    assert got == {1: (2, True), 2: (2, True), 3: (0, False), 4: (0, False), 5: (15, True)}
    strongest = {r["id"]: r["risk_factors"] for r in explain.signal_cautions(_signals(spark), ["id"], ["f", "g", "h"], 0.7, k=1).collect()}
    assert strongest == {1: 2, 2: 1, 3: 0, 4: 0, 5: 5}


@pytest.mark.parametrize("key", ["W29_top_impacts", "W29_signal_cautions"])
def test_signals_of_several_rows_as_in_sql(spark, sf, tmp_path, key):
    """Each row three more times under its key, with another tax: more contributions than TOP_IMPACTS."""
    duckdb.execute(f"""COPY (SELECT * EXCLUDE (i) REPLACE (l_tax + i * 0.1 AS l_tax, l_quantity + i AS l_quantity) FROM '{sf}/lineitem.parquet',
        (SELECT unnest(range(4)) AS i) WHERE l_orderkey % 5 = 0) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    query = everything()[key]
    assert differences(query.run(spark, str(tmp_path)), connect(str(tmp_path)), query.oracle()) == []


def test_a_sweep_reads_its_rows_once(spark, sf):
    from tickframe.sources import views
    before = _plan(metrics.threshold_sweep(views.scored(spark, sf), periods="date"))
    assert "lineitem" not in before and "outcomes-" in before


def test_equal_outcomes_have_no_spread(spark):
    rows = [("2024-01-01", 0.9, 1, 12.345, None), ("2024-01-01", 0.8, 1, 12.345, -1.0), ("2024-01-02", 0.8, 1, 12.345, None), ("2024-01-02", 0.9, 0, 5.0, None)]
    df = spark.createDataFrame(rows, "date string, proba double, target int, max_gain_120m double, min_loss_120m double")
    for medians in (True, False):
        got = {r["period"]: r for r in metrics.threshold_sweep(df, (0.75,), periods="date", medians=medians).collect()}
        assert [got[p]["tp_profit_pct_count"] for p in ("all", "2024-01-01", "2024-01-02")] == [3, 2, 1]
        assert {got[p]["tp_profit_pct_std"] for p in ("all", "2024-01-01", "2024-01-02")} == {0.0}
        assert got["all"]["fp_loss_pct_count"] == 0 and got["all"]["fp_loss_pct_avg"] is None and got["all"]["false_positives"] == 1


class _Calls:
    """A processor's handle that holds one value and one set of timers, and cannot list them."""

    def __init__(self):
        self.value, self.timers, self.sent = None, set(), 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.sent = value, self.sent + 1

    def clear(self):
        self.value = None


def test_last_wins_sends_one_value_a_key_and_knows_its_timer(spark):
    from pyspark.sql import Row, types as T
    from tickframe.streaming import state
    held, calls = state._LastWins(T.StructType.fromDDL("ts_ms long, n long"), "ts_ms", ["n"], 10), _Calls()
    held.init(calls)
    list(held.handleInputRows((), iter([Row(ts_ms=50, n=1), Row(ts_ms=55, n=2), Row(ts_ms=70, n=3)]), None))
    assert calls.sent == 1 and calls.timers == {61} and calls.value == ([(50, 55, 2), (70, 70, 3)],)
    list(held.handleInputRows((), iter([Row(ts_ms=30, n=4)]), None))
    assert calls.timers == {41}
