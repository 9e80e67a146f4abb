"""Exact quantiles without gathering a group in one task.

Equal values are counted first, before any shuffle where they are many.  Counts
per logarithmic bin find the bins that hold the wanted ranks; only the values of
these bins are ordered, in fine steps of a bin, so that a narrow measure with
many distinct values is spread over tasks too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BINS_PER_E = 512
_BIN_OFFSET = 400_000
FINE = 4096  # steps per bin


def log_bin(v: Column, fine: int = 1) -> Column:
    """A monotone integer bin of about 0.2 % relative width, or a step of one."""
    size = F.floor(F.ln(F.abs(v)) * (_BINS_PER_E * fine)) + _BIN_OFFSET * fine
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
                    levels: tuple[str, int] | None = None, complement: bool = False,
                    rollup: Callable[[DataFrame], DataFrame] | None = None,
                    rolled_by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per group with a linearly interpolated quantile per entry of ``probs``.

    ``levels=(col, k)`` answers for k nested groups at once: level i of the output
    column ``level`` covers the rows with ``col > i``.  With ``complement`` level
    k + i covers the other rows.  Levels are counted side by side in columns, so
    rows are not replicated.

    ``rollup`` maps rows keyed by ``by`` to rows keyed by ``rolled_by`` (for
    example days to days, months and the whole); counts of equal values are
    rolled up instead of the rows.  A row stands for ``weight`` equal ones, where
    rows are counted already.
    """
    by = list(by)
    base = df.select(*by, (F.col(levels[0]) if levels else F.lit(0)).alias("_c"),
                     F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    values = base.where(F.col("_v").isNotNull()).groupBy(*by, "_c", "_v").agg(F.sum("_w").alias("_w")).withColumn("_bin", log_bin(F.col("_v")))
    k = levels[1] if levels else 0
    names = ["_all", *[f"_n{i}" for i in range(k)]]
    counts = [F.sum("_w").alias("_all"),
              *[F.coalesce(F.sum(F.when(F.col("_c") > i, F.col("_w"))), F.lit(0)).alias(f"_n{i}") for i in range(k)]]

    def per_level(cols: dict[str, Column]) -> Column:
        """Array over levels of a count known for the nested groups and for all rows."""
        nested = [cols[c] for c in names[1:]] or [cols["_all"]]
        return F.array(*nested, *([cols["_all"] - c for c in nested] if complement else []))

    def with_before(counted: DataFrame, part: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*(part or [F.lit(0)])).orderBy(order)
        ahead = w.rowsBetween(Window.unboundedPreceding, -1)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        summed = counted.select(
            *part, order, *names,
            *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_b") for c in names],
            *[F.sum(c).over(every).alias(f"{c}_t") for c in names])
        return summed.select(*part, order, *[
            per_level({c: F.col(c + tail) for c in names}).alias(out)
            for out, tail in (("_n", ""), ("_b", "_b"), ("_t", "_t"))])

    # the bins that hold the lower and upper neighbour of each wanted rank
    binned = values.groupBy(*by, "_bin").agg(*counts)
    if rollup:
        by, values = list(rolled_by), rollup(values)
        binned = rollup(binned).groupBy(*by, "_bin").agg(*[F.sum(c).alias(c) for c in names])
    hist = with_before(binned, by, "_bin")

    def wanted(at: Column, i: Column, p: str, q: float) -> Column:
        h = F.lit(float(q)) * (at["_t"] - 1)
        here = lambda rank: F.when((rank >= at["_b"]) & (rank < at["_b"] + at["_n"]), rank - at["_b"])
        return F.struct(i.alias("level"), F.lit(p).alias("_p"), h.alias("_h"), here(F.floor(h)).alias("_klo"), here(F.ceil(h)).alias("_khi"))

    zipped = F.arrays_zip("_n", "_b", "_t")
    each = lambda p, q: F.transform(zipped, lambda at, i: wanted(at, i, p, q))
    hits = F.concat(*[F.filter(each(p, q), lambda x: x["_klo"].isNotNull() | x["_khi"].isNotNull()) for p, q in probs.items()])
    targets = hist.select(*by, "_bin", F.inline(hits))

    # the values of those bins, ordered in fine steps
    cells = targets.select(*by, "_bin").distinct()
    near = values.join(cells, [*by, "_bin"], "left_semi").groupBy(*by, "_bin", "_v").agg(*counts)
    near = near.withColumn("_step", log_bin(F.col("_v"), FINE))
    steps = with_before(near.groupBy(*by, "_bin", "_step").agg(*[F.sum(c).alias(c) for c in names]), [*by, "_bin"], "_step")
    exact = with_before(near, [*by, "_bin", "_step"], "_v").select(*by, "_bin", "_step", "_v", "_n", F.col("_b").alias("_inside"))
    level = F.col("level")
    keys = [*by, "level"] if levels else by
    pairs = steps.select(*by, "_bin", "_step", F.col("_n").alias("_step_n"), "_b").join(targets, [*by, "_bin"])
    first, size = F.get("_b", level), F.get("_step_n", level)
    within = lambda rank: (rank >= first) & (rank < first + size)
    pairs = pairs.where(within(F.col("_klo")) | within(F.col("_khi"))).select(
        *by, "_bin", "_step", "level", "_p", "_h", *[(F.when(within(F.col(c)), F.col(c) - first)).alias(c) for c in ("_klo", "_khi")])
    start = F.get("_inside", level)
    at = lambda rank: F.when((rank >= start) & (rank < start + F.get("_n", level)), F.col("_v"))
    found = exact.join(pairs, [*by, "_bin", "_step"]).groupBy(*keys, "_p", "_h").agg(
        F.max(at(F.col("_klo"))).alias("_lo"), F.max(at(F.col("_khi"))).alias("_hi"))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_p") == p, q)).alias(p) for p in probs])
