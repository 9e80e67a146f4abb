"""Global order statistics built from small histograms instead of one global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_DIGITS = 3  # hex digits per refinement: 4,096 buckets


def global_position(df: DataFrame, ts: str, tie: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position of each row in (ts, tie) order over the whole table.

    Rows are cut into sampled, even ranges of the full order, so a crowded
    timestamp is split by its ties, sorted inside their range and numbered as they
    are written.  After that only the ranges' sizes (one row per range) are summed
    globally; the rows are shuffled once.
    """
    ranged = df.repartitionByRange(F.col(ts), *[F.col(c) for c in tie]).sortWithinPartitions(ts, *tie)
    # the id counts up inside a partition and has the partition's number above its 33 lowest bits
    placed = materialise(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    range_ = F.shiftright("_place", 33)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that its size is known and the table is not shuffled once more for the join
    base = materialise(placed.groupBy(range_.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
                       .select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base")), "bases")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_range", range_).join(base, "_range")
            .withColumn(name, F.col("_base") + inside).drop("_range", "_base", "_place"))


def shuffle_key(seed: int, keys: Sequence[str]) -> Column:
    """A reproducible pseudo-random order: md5 of seed and row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def smallest_by_hash(df: DataFrame, hash_col: str, take: DataFrame, by: Sequence[str],
                     tie: Sequence[str]) -> DataFrame:
    """The first ``_take`` rows of each group in hash order.

    ``take`` has one row per group (``by`` + ``_take``).  Counts per leading digits
    of the hash find the bucket the limit falls into, and counts per longer prefix
    within it the bucket's part, about a sixteen-millionth of the group.  Only that
    part is ordered; all others are kept or left by comparing hashes.  The limits are written
    before they are joined: their size is known then, so a few groups never gather in as many tasks.
    """
    by = list(by)

    def edge(hist_of: DataFrame, limit: DataFrame, digits: int) -> DataFrame:
        """(by, prefix, left): the bucket at the limit and how many of its rows are taken."""
        upto = Window.partitionBy(*by).orderBy("_pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = (hist_of.groupBy(*by, F.substring(hash_col, 1, digits).alias("_pre")).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_c", F.sum("_n").over(upto)).join(limit, by).withColumn("_start", F.col("_c") - F.col("_n")))
        return hist.where((F.col("_c") > F.col("_take")) & (F.col("_start") <= F.col("_take"))).select(
            *by, F.col("_pre").alias("_edge"), (F.col("_take") - F.col("_start")).alias("_left"))

    # read three times: written once, so that the hashes and what lies below are not worked out again
    slim = materialise(df.select(*by, hash_col, *[c for c in tie if c not in by]), "hashes")
    take = materialise(take, "take")
    coarse = materialise(edge(slim, take, _DIGITS), "edge")
    open_ = slim.join(coarse, by).where(F.substring(hash_col, 1, _DIGITS) == F.col("_edge"))
    fine = materialise(edge(open_.drop("_edge", "_left"), coarse.select(*by, F.col("_left").alias("_take")), 2 * _DIGITS), "edge")
    order = Window.partitionBy(*by).orderBy(hash_col, *tie)
    rest = (open_.drop("_left", "_edge").join(fine, by).where(F.substring(hash_col, 1, 2 * _DIGITS) == F.col("_edge"))
            .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= F.col("_left")))
    # the last row taken: everything up to it in (hash, tie) order is taken
    names = [hash_col, *[c for c in tie if c not in by]]
    last = materialise(rest.groupBy(*by).agg(F.max(F.struct(*names)).alias("_last")), "edge")
    bound = materialise(take.select(*by).join(coarse.select(*by, F.lit(True).alias("_cut")), by, "left")
             .join(fine.select(*by, F.col("_edge").alias("_fine")), by, "left").join(last, by, "left"), "bound")
    joined = df.join(bound, by)
    inside = F.coalesce(F.struct(*names) <= F.col("_last"), F.lit(False))
    keep = F.col("_cut").isNull() | (F.col(hash_col) < F.col("_fine")) | inside
    return joined.where(keep).select(*df.columns)
