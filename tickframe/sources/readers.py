"""Reading landing tables and shaping raw records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.numeric import nan_to_null

# Vendor short names of bar fields.
SHORT_NAMES = {"t": "timestamp", "o": "open", "h": "high", "l": "low", "c": "close",
               "v": "volume", "vw": "vwap", "n": "transactions"}
LABEL_COLUMNS = ("target", "max_gain_120m", "min_loss_120m", "time_to_max_min", "max_gain_pct")


def between_dates(df: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Inclusive bounds, each optional; prunes partitions when ``date`` is one."""
    if start is not None:
        df = df.where(F.col(date) >= start)
    if end is not None:
        df = df.where(F.col(date) <= end)
    return df


def scan_bars(spark: SparkSession, path: str, source: str | None = None, start: str | None = None,
              end: str | None = None, schema: T.StructType = schemas.OPTION_BAR) -> DataFrame:
    """Bars of a table partitioned by (source, trade_date)."""
    parts = [T.StructField("source", T.StringType()), T.StructField("trade_date", T.StringType())]
    full = T.StructType([f for f in schema.fields if f.name != "source"] + parts)
    df = between_dates(spark.read.schema(full).parquet(path), start, end, "trade_date")
    return nan_to_null(df.where(F.col("source") == source) if source else df)


def scan_contracts(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                   multi_line: bool = True) -> DataFrame:
    """Contract lists under trade_date=…/: one JSON array per file, or one object per line."""
    schema = T.StructType([*schemas.CONTRACT.fields, T.StructField("trade_date", T.StringType())])
    return between_dates(spark.read.schema(schema).json(path, multiLine=multi_line), start, end, "trade_date")


def scan_news(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    schema = T.StructType([*schemas.NEWS.fields, T.StructField("trade_date", T.StringType())])
    return between_dates(spark.read.schema(schema).parquet(path), start, end, "trade_date")


def csv_by_name(spark: SparkSession, path: str, schema: T.StructType, skip_unreadable: bool = False) -> DataFrame:
    """CSV columns by the names in the header, in any order, and the file of each row as ``_file``.

    Missing columns are NULL, others are ignored, values that don't parse are NULL.
    A file whose header differs from the first one's fails the read instead of
    putting values under other names.
    """
    raw = (spark.read.option("header", "true").option("enforceSchema", "false")
           .option("ignoreCorruptFiles", str(skip_unreadable).lower()).csv(path))
    one = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
    return raw.select(*[one(f).alias(f.name) for f in schema.fields], F.col("_metadata.file_path").alias("_file"))


def files_without_rows(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Files of a folder that are not the ``_file`` of any of ``rows``: empty or unreadable."""
    every = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"))
    return every.join(rows.select("_file").distinct(), "_file", "left_anti")


def load_features(spark: SparkSession, path: str, schema: T.StructType, start: str | None = None,
                  end: str | None = None, fmt: str = "parquet", date_from_name: bool = False,
                  skip_unreadable: bool = False) -> DataFrame:
    """Feature rows within the bounds.

    An unreadable file fails the read unless the caller asks to skip such files;
    ``files_without_rows`` then names them by the column ``_file``.  ``date_from_name`` takes the date from ``YYYY-MM-DD_features.csv`` names.
    """
    if fmt == "csv":
        df = csv_by_name(spark, path, schema, skip_unreadable)
    else:
        df = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(path)
        df = df.select("*", F.col("_metadata.file_path").alias("_file"))
    if date_from_name:
        df = df.withColumn("date", F.regexp_extract("_file", r"/(\d{4}-\d{2}-\d{2})_[^/]*$", 1))
    return nan_to_null(between_dates(df, start, end))


def scan_labelable(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV or Parquet by suffix, without labels of an earlier run."""
    df = csv_by_name(spark, path, schema) if path.rstrip("/").endswith(".csv") else spark.read.schema(schema).parquet(path)
    return nan_to_null(drop_labels(df.select(*schema.fieldNames())))


def drop_labels(df: DataFrame) -> DataFrame:
    return df.drop(*LABEL_COLUMNS)


def load_event_reports(spark: SparkSession, path: str, forward: bool, start: str | None = None,
                       end: str | None = None) -> DataFrame:
    """All report files; overlapping forward reports are deduplicated, backward ones are not."""
    schema = schemas.EVENT_FORWARD if forward else schemas.EVENT_BACKWARD
    df = between_dates(csv_by_name(spark, path, schema).select(*schema.fieldNames()), start, end)
    return unique_forward_events(df) if forward else df


def unique_forward_events(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["date", "ticker", "entry_time_et", "trigger_time_et"])


def normalise_bars(raw: DataFrame, source: str, ticker: bool = False) -> DataFrame:
    """Vendor record → bar schema with a literal source."""
    def one(short: str, long: str) -> Column:
        kind = "long" if long in ("timestamp", "volume", "transactions") else "double"
        value = F.col(short) if short in raw.columns else F.col(long) if long in raw.columns else F.lit(None)
        return value.cast(kind).alias(long)
    extra = [F.col("ticker")] if ticker else []
    return raw.select(*[one(s, l) for s, l in SHORT_NAMES.items()], F.lit(source).alias("source"), *extra)


def normalise_news(raw: DataFrame, ticker: str, source: str = "news") -> DataFrame:
    """Flatten articles; sentiment of the first insight on ``ticker``, else of the first one."""
    own = F.get(F.filter("insights", lambda i: i["ticker"] == ticker), F.lit(0))
    insight = F.coalesce(own, F.get("insights", F.lit(0)))
    return raw.select(
        F.unix_millis(F.try_to_timestamp("published_utc")).alias("timestamp"),
        F.col("id").alias("article_id"), "title", "description", "author", "article_url",
        "tickers", "keywords", insight["sentiment"].alias("sentiment"),
        insight["sentiment_reasoning"].alias("sentiment_reasoning"),
        F.col("publisher.name").alias("publisher_name"), F.lit(source).alias("source"))


def normalise_contracts(raw: DataFrame, columns: Sequence[str] = tuple(f.name for f in schemas.CONTRACT.fields)) -> DataFrame:
    shaped = {"contract_type": F.lower("contract_type"), "strike_price": F.col("strike_price").cast("double")}
    return raw.select(*[shaped.get(c, F.col(c)).alias(c) for c in columns if c in raw.columns])
