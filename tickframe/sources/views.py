"""The driver's tables read as bars, contracts, scored rows and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import resample_ohlcv

BAR_MS = 900_000  # the event stream is sparse: 15-minute bars
UNDERLYING, INDEX, NEWS = "view", "click", "error"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """One price tick per event: ticker, date, ms time, price and size."""
    e = table(spark, sf, "events")
    at = F.col("ts").cast("timestamp")
    size = F.get_json_object("props", "$.k").cast("long") + 1
    price = F.col("value")
    return e.select(
        "event_id", F.col("event_type").alias("ticker"), F.date_format(at, "yyyy-MM-dd").alias("trade_date"),
        F.unix_millis(at).alias("ts_ms"), price.alias("price"), price.alias("open"), price.alias("high"),
        price.alias("low"), price.alias("close"), size.alias("volume"), price.alias("vwap"),
        F.lit(1).cast("long").alias("transactions"), "user_id")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """15-minute bars per ticker and day (96 at most)."""
    return resample_ohlcv(ticks(spark, sf), ("ticker", "trade_date"), BAR_MS, order="event_id")


def underlying_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).where(F.col("ticker") == UNDERLYING)


def index_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).where(F.col("ticker") == INDEX)


def option_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).where(F.col("ticker").isin("purchase", "signup"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).where(F.col("ticker") == NEWS)
    return t.select("trade_date", "ts_ms", F.col("event_id").alias("article_id"),
                    F.when(F.col("price") > 50, "positive").otherwise("negative").alias("sentiment"),
                    F.concat(F.lit("size "), F.col("volume").cast("string")).alias("sentiment_reasoning"))


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as listed contracts."""
    expiry = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    kind = F.when(F.pmod("p_partkey", F.lit(2)) == 0, "call").otherwise("put")
    return table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_partkey"),
        F.col("p_retailprice").alias("strike_price"), F.date_format(expiry, "yyyy-MM-dd").alias("expiration_date"),
        kind.alias("contract_type"))


def event_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the option tickers of the event stream, one per ticker and day.

    The strike is the day's mean price, the expiry two days on.
    """
    return option_ticks(spark, sf).groupBy("trade_date", "ticker").agg(F.round(F.avg("price"), 0).alias("strike_price")).select(
        "trade_date", "ticker", "strike_price",
        F.date_format(F.date_add(F.to_date("trade_date"), 2), "yyyy-MM-dd").alias("expiration_date"),
        F.when(F.col("ticker") == "purchase", "CALL").otherwise("PUT").alias("contract_type"))


def option_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of the option tickers with a contract symbol."""
    b = bars(spark, sf).where(F.col("ticker").isin("purchase", "signup"))
    day = F.date_format(F.date_add(F.to_date("trade_date"), 3), "yyMMdd")
    kind = F.when(F.col("ticker") == "purchase", "C").otherwise("P")
    return b.withColumn("symbol", F.concat(F.lit("O:UND"), day, kind, F.lit("00025000")))


ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as labelled, scored bars."""
    l = table(spark, sf, "lineitem")
    at = F.col("l_shipdate").cast("timestamp")
    last = F.col("l_quantity") == 50  # no forward window: NULL outcome
    mix = lambda a, b, c: F.pmod(F.col("l_orderkey") * a + F.col("l_partkey") * b
                                 + F.col("l_linenumber") * c, F.lit(1000)) / F.lit(1000.0)
    kind = F.when(F.pmod("l_partkey", F.lit(2)) == 0, "C").otherwise("P")
    return l.select(
        *ROW_KEY, F.date_format(at, "yyyy-MM-dd").alias("date"),
        (F.unix_millis(at) + F.pmod(F.col("l_orderkey") * 7919, F.lit(23_400)) * 1000).alias("timestamp"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        mix(31, 17, 7).alias("proba"), mix(13, 29, 3).alias("proba_b"), mix(7, 11, 5).alias("proba_c"),
        F.when(~last, F.col("l_discount") * 400).alias("max_gain_120m"),
        F.when(~last, F.col("l_tax") * -300).alias("min_loss_120m"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 2.5).alias("time_to_max_min"),
        (F.floor(F.col("l_extendedprice") * 100 / 750) / 100).alias("close"),
        (9 + F.pmod("l_linenumber", F.lit(7))).cast("long").alias("hour_et"),
        F.pmod("l_partkey", F.lit(60)).cast("long").alias("minute_et"),
        F.concat(F.lit("O:UND"), F.date_format(at, "yyMMdd"), kind,
                 F.format_string("%08d", F.col("l_partkey") * 100)).alias("ticker"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")


def scored_models(spark: SparkSession, sf: str) -> DataFrame:
    """Three score columns as long rows (model, proba)."""
    s = scored(spark, sf)
    named = {"a": "proba", "b": "proba_b", "c": "proba_c"}
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in named.items()]))
    return s.select("*", each).drop(*named.values()).withColumnRenamed("p", "proba")
