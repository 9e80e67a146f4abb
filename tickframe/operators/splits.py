"""Chronological splits, walk-forward windows, folds and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import global_position

# Default shares.
TRAIN_SHARE, VAL_SHARE = 0.70, 0.15
FIT_SHARE, MIN_FIT_DATES = 0.80, 5


def _cut(n: Column, share: float) -> Column:
    return F.floor(n * F.lit(share)).cast("long")


def split_dates(dates: DataFrame, train: float = TRAIN_SHARE, val: float = VAL_SHARE,
                col: str = "date") -> DataFrame:
    """date → split.  Whole days stay together; three days or more fill every split.

    The window runs over the distinct dates only, which the calendar bounds.
    """
    if train <= 0 or val <= 0 or train + val >= 1:
        raise ValueError("shares must be positive and leave room for a test split")
    d = dates.select(col).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy(col))
    t0, v0 = _cut(n, train), _cut(n, train + val)
    t1 = F.greatest(t0, F.lit(1))
    v1 = F.least(F.greatest(v0, t1 + 1), n - 1)
    staged = (d.withColumn("_i", i).withColumn("_n", n)
              .withColumn("_v", F.when(n >= 3, v1).otherwise(v0))
              .withColumn("_t", F.when(n >= 3, F.least(t1, F.col("_v") - 1)).otherwise(t0)))
    split = (F.when(F.col("_i") <= F.col("_t"), "train")
             .when(F.col("_i") <= F.col("_v"), "val").otherwise("test"))
    return staged.select(col, split.alias("split"))


def chronological_split(df: DataFrame, train: float = TRAIN_SHARE, val: float = VAL_SHARE,
                        ts: str = "timestamp", date: str = "date", tie: Sequence[str] = ()) -> DataFrame:
    """The input with a ``split`` column; by date when there is one, else by row order."""
    if date in df.columns:
        return df.join(F.broadcast(split_dates(df, train, val, date)), date)  # calendar days
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = global_position(df, ts, tie, "_pos")
    return placed.withColumn(
        "split", F.when(F.col("_pos") < _cut(n, train), "train")
        .when(F.col("_pos") < _cut(n, train + val), "val").otherwise("test")).drop("_pos")


def split_summary(df: DataFrame, date: str = "date", ts: str = "timestamp", target: str = "target") -> DataFrame:
    """Rows, date and time range and positive rate per split."""
    daily = df.groupBy("split", date).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("pos"),
        F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    return daily.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        F.count(F.lit(1)).alias("n_dates"), F.min("t0").alias("min_ts"), F.max("t1").alias("max_ts"),
        (F.sum("pos") / F.sum("n")).alias("positive_rate"))


def walk_forward_splits(df: DataFrame, train_months: int = 3, test_months: int = 1,
                        date: str = "date") -> DataFrame:
    """Sliding calendar-month windows; a test window must end by the last date."""
    span = df.agg(F.min(F.to_date(date)).alias("d0"), F.max(F.to_date(date)).alias("d1"))
    starts = span.select("d1", F.explode(F.sequence(
        F.trunc("d0", "MM"), F.trunc("d1", "MM"), F.expr(f"interval {test_months} month"))).alias("s"))
    test_start = F.add_months("s", train_months)
    test_end = F.date_sub(F.add_months("s", train_months + test_months), 1)
    kept = starts.where(test_end <= F.col("d1"))
    return kept.select(
        F.row_number().over(Window.orderBy("s")).cast("long").alias("split_index"),
        F.date_format("s", "yyyy-MM-dd").alias("train_start"),
        F.date_format(F.date_sub(test_start, 1), "yyyy-MM-dd").alias("train_end"),
        F.date_format(test_start, "yyyy-MM-dd").alias("test_start"),
        F.date_format(test_end, "yyyy-MM-dd").alias("test_end"))


def fit_val_split(df: DataFrame, date: str = "date") -> DataFrame:
    """``part`` = fit or val: the last fifth of the dates validates when there are five or more."""
    d = df.select(date).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy(date))
    part = F.when((n >= MIN_FIT_DATES) & (i > _cut(n, FIT_SHARE)), "val").otherwise("fit")
    return df.join(F.broadcast(d.select(date, part.alias("part"))), date)  # calendar days


def fold_ranges(rows: int, k: int = 5) -> list[tuple[int, int]]:
    """(start, end) positions of each fold's test block; its training rows are all before the start."""
    size = rows // (k + 1)
    return [(rows - (k - i) * size, rows - (k - i - 1) * size) for i in range(k)]


def timeseries_folds(df: DataFrame, k: int = 5, ts: str = "timestamp", tie: Sequence[str] = (),
                     position: str | None = None) -> DataFrame:
    """Long form (fold, role, row): expanding training blocks with equal test blocks.

    A row is emitted once per fold it belongs to (at most k copies), by its
    position in time order.
    """
    placed = df if position else global_position(df, ts, tie, "_pos")
    pos, rows = F.col(position or "_pos"), F.col("_all")
    placed = placed.withColumn("_all", df.agg(F.count(F.lit(1))).scalar())
    size = F.floor(rows / (k + 1))
    start = lambda i: rows - (F.lit(k) - i) * size
    member = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: pos < start(i) + size)
    out = placed.withColumn("fold", F.explode(member))
    out = out.withColumn("role", F.when(pos < start(F.col("fold")), "train").otherwise("test")).drop("_all")
    return out if position else out.drop("_pos")


def sliding_sequences(df: DataFrame, features: Sequence[str], seq_len: int, by: Sequence[str],
                      ts: str, target: str = "target") -> DataFrame:
    """array<array<float>> of the preceding ``seq_len`` rows, labelled with the row after them."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(-seq_len, -1)
    row = F.array(*[F.col(c).cast("float") for c in features])
    return (df.withColumn("sequence", F.collect_list(row).over(w))
            .where(F.size("sequence") == seq_len).withColumn("label", F.col(target)))


def rows_in_splits(df: DataFrame, splits: DataFrame, part: str = "test", date: str = "date") -> DataFrame:
    """Rows of each window's train or test range.

    Windows are spread over their calendar months, so the join is an equality
    on the month with the exact range as residual; windows are a few per year.
    """
    lo, hi = F.col(f"{part}_start"), F.col(f"{part}_end")
    months = F.sequence(F.trunc(F.to_date(lo), "MM"), F.to_date(hi), F.expr("interval 1 month"))
    spread = splits.withColumn("_month", F.explode(F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))))
    joined = df.withColumn("_month", F.substring(date, 1, 7)).join(spread, "_month")
    return joined.where((F.col(date) >= lo) & (F.col(date) <= hi)).drop("_month")


def date_splits(spark: SparkSession, dates: Sequence[str]) -> DataFrame:
    """Split an explicit list of dates."""
    return split_dates(spark.createDataFrame([(d,) for d in dates], "date string"))
