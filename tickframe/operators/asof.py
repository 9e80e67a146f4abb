"""Backward as-of joins.

``asof_join`` handles any two series.  The match depends only on (keys, timestamp), so it is computed on the distinct
left timestamps and joined back by equality.  A hot instrument on the left
therefore adds nothing to the ordered part, and the equality join is one that
adaptive execution can split when skewed.  The ordered part is cut into time
slices; each slice holds at most one row per side and millisecond, and the last
right row of earlier slices is carried in from a table of one row per slice.

``asof_grid`` and ``asof_bars`` use that bars lie on a fixed grid of times, which
bounds the rows per day; they need no distinct pass over the left side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def asof_join(left: DataFrame, right: DataFrame, on: str = "ts_ms", by: Sequence[str] = ("trade_date",),
              tolerance: int | None = None, tie: str | None = None,
              slice_width: int | None = HOUR_MS) -> DataFrame:
    """Left rows with the last right row at or before them and the same ``by`` keys.

    ``tie`` ranks right rows sharing a timestamp (the highest wins); without it
    the right side must be unique per key and timestamp.  ``tolerance`` (in
    units of ``on``) drops older matches, the bound itself still matches.
    Right rows without a time match nothing.  Long days are cut into slices of
    ``slice_width``; None takes a day as one slice, which is enough for bars.
    """
    keys = list(by)
    right = right.where(F.col(on).isNotNull())
    payload = [c for c in right.columns if c not in (on, *keys)]
    packed = F.struct(F.col(on).alias("_at"), *payload)
    if tie:
        side = right.groupBy(*keys, on).agg(F.max_by(packed, tie).alias("_r"))
    else:
        side = right.select(*keys, on, packed.alias("_r"))
    probe = left.select(*keys, on).where(F.col(on).isNotNull()).distinct()
    marks = (probe.withColumn("_probe", F.lit(True))
             .unionByName(side.withColumn("_probe", F.lit(False)), allowMissingColumns=True))

    if slice_width is None:
        w = Window.partitionBy(*keys).orderBy(on)
        found = marks.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_probe")
    else:
        cut = marks.withColumn("_slice", F.floor(F.col(on) / slice_width))
        w = Window.partitionBy(*keys, "_slice").orderBy(on)
        inside = cut.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_probe")
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            cut.groupBy(*keys, "_slice")
            .agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(on))).alias("_end"))
            .withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
            .select(*keys, "_slice", "_carry")
        )
        found = (inside.join(carried, [*keys, "_slice"])
                 .withColumn("_r", F.coalesce("_r", "_carry")))

    if tolerance is not None:
        found = found.where(F.col(on) - F.col("_r._at") <= tolerance)
    matched = found.select(*keys, on, *[F.col(f"_r.{c}").alias(c) for c in payload])
    return left.join(matched, [*keys, on], "left")


def asof_grid(left: DataFrame, right_bars: DataFrame, grid_ms: int, by: Sequence[str] = ("trade_date",),
              on: str = "ts_ms") -> DataFrame:
    """As-of join of any rows against bars whose times are multiples of ``grid_ms``.

    Each right bar is repeated for the empty grid steps it covers until the next
    bar or midnight (at most one day of steps per key), which turns the join into
    an equality: the left side, where the hot instruments are, is never ordered.
    """
    keys = list(by)
    payload = [c for c in right_bars.columns if c not in (on, *keys)]
    midnight = (F.floor(F.col(on) / DAY_MS) + 1) * DAY_MS
    until = F.coalesce(F.lead(on).over(Window.partitionBy(*keys).orderBy(on)), midnight)
    dense = (right_bars.withColumn("_until", until)
             .select(*keys, *payload, F.explode(F.sequence(F.col(on), F.col("_until") - 1, F.lit(grid_ms))).alias("_slot")))
    slot = F.col(on) - F.pmod(F.col(on), F.lit(grid_ms))
    return left.withColumn("_slot", slot).join(dense, [*keys, "_slot"], "left").drop("_slot")


def asof_bars(left_bars: DataFrame, right: DataFrame, grid_ms: int, by: Sequence[str] = ("trade_date",),
              on: str = "ts_ms", tolerance: int | None = None, tie: str | None = None) -> DataFrame:
    """As-of join of bars (unique per key and grid time) with any right rows.

    The right side is first reduced to its last row per grid step, so both sides
    are bounded per day; one union and one window leave the result partitioned
    and ordered for the indicators that follow.
    """
    keys = list(by)
    payload = [c for c in right.columns if c not in (on, *keys)]
    order = F.struct(on, tie) if tie else F.col(on)
    step = F.col(on) + F.pmod(-F.col(on), F.lit(grid_ms))
    last = (right.groupBy(*keys, step.alias("_step")).agg(F.max_by(F.struct(F.col(on).alias("_at"), *payload), order).alias("_r"))
            .withColumnRenamed("_step", on))
    both = left_bars.withColumn("_left", F.lit(True)).unionByName(
        last.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_left")
    fresh = F.lit(True) if tolerance is None else F.col(on) - F.col("_r._at") <= tolerance
    return out.select(*left_bars.columns, *[F.when(fresh, F.col(f"_r.{c}")).alias(c) for c in payload])
