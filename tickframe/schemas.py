"""Declared record schemas.  Timestamps are Unix milliseconds (UTC)."""

from pyspark.sql import types as T

EQUITY_BAR = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("vwap", T.DoubleType()),
    T.StructField("transactions", T.LongType()),
    T.StructField("source", T.StringType()),
])
INDEX_BAR = EQUITY_BAR
OPTION_BAR = T.StructType(EQUITY_BAR.fields + [T.StructField("ticker", T.StringType())])
CONTRACT = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("underlying_ticker", T.StringType()),
    T.StructField("strike_price", T.DoubleType()),
    T.StructField("expiration_date", T.StringType()),
    T.StructField("contract_type", T.StringType()),
    T.StructField("exercise_style", T.StringType()),
    T.StructField("primary_exchange", T.StringType()),
    T.StructField("shares_per_contract", T.IntegerType()),
])
NEWS_RAW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("published_utc", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("insights", T.ArrayType(T.StructType([
        T.StructField("ticker", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("sentiment_reasoning", T.StringType()),
    ]))),
    T.StructField("publisher", T.StructType([T.StructField("name", T.StringType())])),
])
NEWS = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("sentiment", T.StringType()),
    T.StructField("sentiment_reasoning", T.StringType()),
    T.StructField("publisher_name", T.StringType()),
    T.StructField("source", T.StringType()),
])
EVENT_BACKWARD = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("trigger_time_et", T.StringType()),
    T.StructField("reference_time_et", T.StringType()),
    T.StructField("gain_pct", T.DoubleType()),
    T.StructField("above_20pct_duration_min", T.LongType()),
    T.StructField("above_10pct_duration_min", T.LongType()),
    T.StructField("reference_price", T.DoubleType()),
    T.StructField("trigger_price", T.DoubleType()),
])
EVENT_FORWARD = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("entry_time_et", T.StringType()),
    T.StructField("trigger_time_et", T.StringType()),
    T.StructField("minutes_to_trigger", T.LongType()),
    T.StructField("gain_pct", T.DoubleType()),
    T.StructField("above_20pct_duration_min", T.LongType()),
    T.StructField("above_10pct_duration_min", T.LongType()),
    T.StructField("entry_price", T.DoubleType()),
    T.StructField("trigger_price", T.DoubleType()),
])
