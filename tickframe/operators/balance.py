"""Class balance: sampling, weights and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_if, ratio
from .ranking import shuffle_key, smallest_by_hash


def undersample_majority(df: DataFrame, keys: Sequence[str], seed: int = 42,
                         target: str = "target") -> DataFrame:
    """All minority rows and as many majority rows, chosen by a seeded hash of the row key.

    ``keys`` must identify a row.  One class, or equal classes, pass unchanged.
    """
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_c"))
    take = counts.select(target, F.min("_c").over(Window.partitionBy()).alias("_take"))
    hashed = df.withColumn("_hash", shuffle_key(seed, keys))
    return smallest_by_hash(hashed, "_hash", take, [target], keys).drop("_hash")


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """n / (classes · count) per class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    everything = Window.partitionBy()
    weight = (F.sum("count").over(everything)
              / (F.count(F.lit(1)).over(everything) * F.col("count")))
    return counts.withColumn("weight", weight)


def attach_class_weight(df: DataFrame, weights: DataFrame, target: str = "target") -> DataFrame:
    """Each row with the weight of its class; one row per class is broadcast, so no class meets in one task."""
    return df.join(F.broadcast(weights.select(target, "weight")), target, "left")


def balance(df: DataFrame, method: str, keys: Sequence[str], seed: int = 42,
            target: str = "target") -> DataFrame:
    if method == "undersample":
        return undersample_majority(df, keys, seed, target)
    if method == "class_weights":
        return df
    raise ValueError(f"unknown balance method {method!r}")


def imbalance_summary(df: DataFrame, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Counts, rate and negatives per positive (infinite without positives)."""
    pos, n = count_if(F.col(target) == 1), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("total"), pos.alias("positives"), (n - pos).alias("negatives"),
        F.coalesce(ratio(pos.cast("double"), n.cast("double")), F.lit(0.0)).alias("positive_rate"),
        F.when(pos > 0, (n - pos) / pos).otherwise(F.lit(float("inf"))).alias("imbalance_ratio"))


def feature_columns(df: DataFrame, reserved: Sequence[str]) -> list[str]:
    return sorted(set(df.columns) - set(reserved))


# Columns that never enter a model.
RESERVED = (
    "date", "ticker", "timestamp", "source", "open", "high", "low", "close", "volume", "vwap",
    "transactions", "opt_close", "target", "max_gain_120m", "min_loss_120m", "max_gain_pct",
    "time_to_max_min",
)


def align_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exactly the model's columns: missing ones as 0.0, NULLs as 0.0."""
    def one(c: str) -> Column:
        return (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, *[one(c) for c in cols])
