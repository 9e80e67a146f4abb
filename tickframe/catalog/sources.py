"""Scans, sinks and record shaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import exchange_clock, partition_date
from ..operators.monitoring import latest_per_group
from ..operators.risk import false_positives
from ..operators.trades import build_trades
from ..session import scratch_path
from ..sources import readers, tables, views
from .base import Catalog, sql

CATALOG = Catalog()
add = CATALOG.add


def _landed_ticks(spark, sf):
    """Ticks as a bar table partitioned by source and day; returns its path."""
    path = scratch_path(spark, "bars")
    t = views.ticks(spark, sf).select(
        F.col("ts_ms").alias("timestamp"), "open", "high", "low", "close", "volume", "vwap", "transactions",
        "ticker", F.when(F.col("ticker") == "view", "spy").otherwise("options").alias("source"), "trade_date")
    tables.write_partitions(t, path, ("source", "trade_date"))
    return path


@add("S1_scan_bars", "ticker:s trade_date:s timestamp:l close:d volume:l source:s", sql(
    """SELECT ticker, trade_date, ts_ms AS timestamp, close, volume,
       CASE WHEN ticker = 'view' THEN 'spy' ELSE 'options' END AS source FROM ticks""", "ticks"))
def scan_bars(spark, sf):
    return readers.scan_bars(spark, _landed_ticks(spark, sf), start="2024-01-01", end="2024-01-31")


@add("S2_scan_contracts", "trade_date:s ticker:s strike_price:d expiration_date:s contract_type:s", sql(
    "SELECT expiration_date AS trade_date, * FROM contracts", "contracts"))
def scan_contracts(spark, sf):
    path = scratch_path(spark, "contracts")
    listed = views.contracts(spark, sf).withColumn("trade_date", F.col("expiration_date"))
    listed.repartition("trade_date").write.partitionBy("trade_date").json(path)
    return readers.scan_contracts(spark, path, multi_line=False)


@add("S3_scan_news", "trade_date:s timestamp:l article_id:s sentiment:s sentiment_reasoning:s", sql(
    "SELECT *, ts_ms AS timestamp FROM news", "news"))
def scan_news(spark, sf):
    path = scratch_path(spark, "news")
    n = views.news(spark, sf).withColumnRenamed("ts_ms", "timestamp").withColumn("article_id", F.col("article_id").cast("string"))
    tables.write_partitions(n, path)
    return readers.scan_news(spark, path, "2024-01-01", "2024-12-31")


_FEATURES = T.StructType([T.StructField("date", T.StringType()), T.StructField("timestamp", T.LongType()),
                          T.StructField("ticker", T.StringType()), T.StructField("target", T.IntegerType()),
                          T.StructField("close", T.DoubleType()), T.StructField("max_gain_120m", T.DoubleType())])


def _landed_features(spark, sf, fmt):
    path = scratch_path(spark, "features") + (".csv" if fmt == "csv" else "")
    tables.write_table(views.scored(spark, sf).select(*_FEATURES.fieldNames()), path, fmt)
    return path


@add("S4_load_features", "date:s n:l positives:l close_sum:d2", sql(
    """SELECT date, count(*) AS n, sum(target) AS positives, sum(close) AS close_sum FROM scored
       WHERE date >= '1995-01-01' AND date <= '2001-12-31' GROUP BY date""", "scored"))
def load_features(spark, sf):
    df = readers.load_features(spark, _landed_features(spark, sf, "parquet"), _FEATURES, "1995-01-01", "2001-12-31")
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"),
                                  F.sum("close").alias("close_sum"))


@add("S5_scan_labelable", "date:s timestamp:l ticker:s close:d n_columns:l", sql(
    "SELECT date, timestamp, ticker, close, 4 AS n_columns FROM scored", "scored"))
def scan_labelable(spark, sf):
    """The file's columns stand in another order than the schema's."""
    path = scratch_path(spark, "features") + ".csv"
    tables.write_table(views.scored(spark, sf).select(*reversed(_FEATURES.fieldNames())), path, "csv")
    df = readers.scan_labelable(spark, path, _FEATURES)
    return df.withColumn("n_columns", F.lit(len(df.columns)))


def _report_rows(spark, sf):
    """Bars as event report rows."""
    b = views.bars(spark, sf)
    clock = exchange_clock(F.col("ts_ms"))
    return b.select(
        F.col("trade_date").alias("date"), "ticker", clock.alias("entry_time_et"), clock.alias("trigger_time_et"),
        F.col("transactions").alias("minutes_to_trigger"), F.col("close").alias("gain_pct"),
        F.col("volume").alias("above_20pct_duration_min"), F.col("transactions").alias("above_10pct_duration_min"),
        F.col("open").alias("entry_price"), F.col("close").alias("trigger_price"))


_REPORT_SQL = """SELECT trade_date AS date, ticker,
    strftime(to_timestamp(ts_ms / 1000) AT TIME ZONE 'UTC' - INTERVAL 5 HOUR, '%H:%M:%S') AS entry_time_et,
    close AS gain_pct, volume AS above_20pct_duration_min, close AS trigger_price FROM bars"""


@add("S6_load_forward_reports",
     "date:s ticker:s entry_time_et:s trigger_time_et:s gain_pct:d above_20pct_duration_min:l trigger_price:d",
     sql(f"SELECT *, entry_time_et AS trigger_time_et FROM ({_REPORT_SQL})", "bars"))
def load_forward_reports(spark, sf):
    path, rows = scratch_path(spark, "reports"), _report_rows(spark, sf)
    tables.write_table(rows, f"{path}/first", "csv")
    tables.write_table(rows, f"{path}/second", "csv")
    return readers.load_event_reports(spark, f"{path}/*", True, "2024-01-01", "2024-12-31")


@add("S6_load_backward_reports",
     "date:s ticker:s trigger_time_et:s reference_time_et:s gain_pct:d above_20pct_duration_min:l trigger_price:d",
     sql(f"""SELECT *, entry_time_et AS trigger_time_et, entry_time_et AS reference_time_et
         FROM ({_REPORT_SQL}), range(2)""", "bars"))
def load_backward_reports(spark, sf):
    path = scratch_path(spark, "reports")
    rows = _report_rows(spark, sf).select(
        "date", "ticker", "trigger_time_et", F.col("entry_time_et").alias("reference_time_et"), "gain_pct",
        "above_20pct_duration_min", "above_10pct_duration_min", F.col("entry_price").alias("reference_price"),
        "trigger_price")
    tables.write_table(rows, f"{path}/first", "csv")
    tables.write_table(rows, f"{path}/second", "csv")
    return readers.load_event_reports(spark, f"{path}/*", False, "2024-01-01", "2024-12-31")


@add("S7_false_positives", "timestamp:l ticker:s predicted_proba:d min_loss_120m:d", sql(
    """SELECT timestamp, ticker, proba AS predicted_proba, min_loss_120m FROM scored
       WHERE proba >= 0.7 AND target = 0""", "scored"))
def load_false_positives(spark, sf):
    return false_positives(build_trades(views.scored(spark, sf), 0.7))


def _yearly(spark, sf):
    l = views.table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_tax",
                    F.date_format("l_shipdate", "yyyy").alias("trade_date"))


@add("S8_upsert_partition", "trade_date:s l_orderkey:l l_linenumber:l l_partkey:l l_extendedprice:d l_tax:d", """
    SELECT * FROM (SELECT strftime(l_shipdate, '%Y') AS trade_date, l_orderkey, l_linenumber, l_partkey,
        CASE WHEN b = 0 THEN l_tax END AS l_tax,
        CASE WHEN b = 1 THEN l_extendedprice + 1 ELSE l_extendedprice END AS l_extendedprice,
        row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y'), l_orderkey, l_linenumber
            ORDER BY b DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
        FROM lineitem, (SELECT unnest([0, 1]) AS b) WHERE b = 0 OR l_returnflag = 'R') WHERE rn = 1""")
def upsert_partition(spark, sf):
    """The second batch lacks a column that the stored rows keep; the test data repeats keys within a batch."""
    path, rows = scratch_path(spark, "upsert"), _yearly(spark, sf)
    late = rows.where(F.col("l_returnflag") == "R").withColumn("l_extendedprice", F.col("l_extendedprice") + 1).drop("l_tax")
    for batch in (rows, late):
        tables.upsert_partitions(batch, path, ("l_orderkey", "l_linenumber"),
                                 arrival=("l_partkey", "l_suppkey", "l_extendedprice"), sort=("l_orderkey",))
    return spark.read.schema(rows.schema).parquet(path)


@add("S9_overwrite_partition", "trade_date:s l_returnflag:s n:l total:d2", """
    SELECT strftime(l_shipdate, '%Y') AS trade_date, l_returnflag, count(*) AS n, sum(l_extendedprice) AS total
    FROM lineitem WHERE strftime(l_shipdate, '%Y') <> '1998' OR l_returnflag = 'R' GROUP BY ALL""")
def overwrite_partition(spark, sf):
    path, rows = scratch_path(spark, "overwrite"), _yearly(spark, sf)
    tables.write_partitions(rows, path, sort=("l_orderkey",))
    fresh = rows.where((F.col("trade_date") == "1998") & (F.col("l_returnflag") == "R"))
    tables.overwrite_partition(fresh, path, sort=("l_orderkey",))
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("trade_date", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"))


@add("S10_existing_keys", "present:b o_orderpriority:s n:l", """
    SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) AS present, o_orderpriority, count(*) AS n
    FROM orders GROUP BY ALL""")
def existing_keys(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderkey").alias("l_orderkey"))
    stored = views.table(spark, sf, "lineitem")
    parts = [tables.existing_keys(orders, stored, ("l_orderkey",), p).withColumn("present", F.lit(p))
             for p in (True, False)]
    return parts[0].unionByName(parts[1]).groupBy("present", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@add("S11_partition_date", "event_id:l trade_date:s", sql("SELECT event_id, trade_date FROM ticks", "ticks"))
def derive_partition_date(spark, sf):
    return views.ticks(spark, sf).select("event_id", partition_date(F.col("ts_ms")).alias("trade_date"))


@add("S12_writers", "fmt:s ticker:s trade_date:s ts_ms:l open:d close:d volume:l", sql(
    "SELECT fmt, bars.* FROM bars, (SELECT unnest(['parquet', 'csv', 'json']) AS fmt)", "bars"))
def writers(spark, sf):
    b = views.bars(spark, sf).select("ticker", "trade_date", "ts_ms", "open", "close", "volume")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, fmt)
        tables.write_table(b, path, fmt)
        reader = spark.read.schema(b.schema)
        back = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
        back = back.withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@add("S13_resume_pending", "source:s date:s", sql(
    """SELECT DISTINCT ticker AS source, trade_date AS date FROM ticks t
       WHERE NOT EXISTS (SELECT 1 FROM ticks d WHERE d.ticker = t.ticker AND d.trade_date = t.trade_date
                         AND d.price > 150)""", "ticks"))
def resume_pending(spark, sf):
    t, path = views.ticks(spark, sf), scratch_path(spark, "ledger")
    days = t.select(F.col("ticker").alias("source"), F.col("trade_date").alias("date"))
    tables.record_done(days.where(F.lit(False)), path)
    tables.record_done(t.where(F.col("price") > 150).select(
        F.col("ticker").alias("source"), F.col("trade_date").alias("date")).distinct(), path)
    return tables.pending(days.distinct(), spark.read.schema(days.schema).parquet(path))


@add("S14_normalise_bars",
     "timestamp:l open:d high:d low:d close:d volume:l vwap:d transactions:l source:s ticker:s", sql(
         "SELECT *, ts_ms AS timestamp, 'equity' AS source FROM bars", "bars"))
def normalise_bars(spark, sf):
    raw = views.bars(spark, sf).select(
        "ticker", F.col("ts_ms").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"),
        F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"),
        F.col("vwap").alias("vw"), F.col("transactions").alias("n"))
    return readers.normalise_bars(raw, "equity", ticker=True)


def _articles(spark, sf):
    """Conversation turns as raw articles: each carries its own and the next turn as insights."""
    from pyspark.sql import Window
    c = views.table(spark, sf, "conversations")
    nxt = lambda col: F.lead(col).over(Window.partitionBy("conv_id").orderBy("turn"))
    insight = lambda r, t, d: F.struct(r.alias("ticker"), t.alias("sentiment"), d.alias("sentiment_reasoning"))
    staged = c.withColumn("_r", nxt("role")).withColumn("_t", nxt("text"))
    both = F.array(insight(F.col("role"), F.length("text").cast("string"), F.col("text")),
                   insight(F.col("_r"), F.length("_t").cast("string"), F.col("_t")))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    return staged.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(F.col("turn") == 5, F.lit("unknown")).otherwise(
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_utc"),
        F.col("role").alias("title"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("article_url"),
        F.array("role").alias("tickers"), F.array().cast("array<string>").alias("keywords"),
        F.when(F.col("turn") == 3, F.array().cast(both_type())).otherwise(
            F.when(F.col("_r").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("insights"),
        F.struct(F.col("role").alias("name")).alias("publisher"))


def both_type() -> str:
    return "array<struct<ticker:string,sentiment:string,sentiment_reasoning:string>>"


@add("S15_normalise_news", "article_id:s timestamp:l sentiment:s sentiment_reasoning:s publisher_name:s source:s", """
    SELECT conv_id || '-' || turn AS article_id,
        CASE WHEN turn <> 5 THEN (1704067200 + conv_id * 60 + turn) * 1000 END AS timestamp,
        CASE WHEN turn = 3 THEN NULL WHEN role = 'assistant' THEN CAST(length(text) AS VARCHAR)
             WHEN r = 'assistant' THEN CAST(length(t) AS VARCHAR) ELSE CAST(length(text) AS VARCHAR) END AS sentiment,
        CASE WHEN turn = 3 THEN NULL WHEN role = 'assistant' THEN text
             WHEN r = 'assistant' THEN t ELSE text END AS sentiment_reasoning,
        role AS publisher_name, 'news' AS source
    FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def normalise_news(spark, sf):
    return readers.normalise_news(_articles(spark, sf), "assistant")


@add("S16_normalise_contracts", "ticker:s strike_price:d expiration_date:s contract_type:s", sql(
    "SELECT * FROM contracts", "contracts"))
def normalise_contracts(spark, sf):
    raw = views.contracts(spark, sf).withColumn("contract_type", F.upper("contract_type")).withColumn(
        "strike_price", F.col("strike_price").cast("string"))
    return readers.normalise_contracts(raw)


@add("S17_latest_per_group", "user_id:l ticker:s ts_ms:l price:d volume:l", sql(
    """SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY user_id, ticker ORDER BY ts_ms DESC) = 1""", "ticks"))
def latest_snapshots(spark, sf):
    t = views.ticks(spark, sf).select("user_id", "ticker", "ts_ms", "price", "volume")
    return latest_per_group(t, ["user_id", "ticker"], "ts_ms")
