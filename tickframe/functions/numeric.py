"""Null-safe arithmetic used by every feature (ANSI mode raises on x/0)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, also where it is used inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL on a zero or NULL denominator."""
    return num / F.nullif(den, F.lit(0.0).cast("double"))


def pct_from(now: Column, base: Column) -> Column:
    """Percent change of ``now`` against ``base``; NULL when base is 0."""
    return ratio(now - base, base.cast("double")) * 100


def log_pct(now: Column, base: Column) -> Column:
    """ln(now/base) in percent; NULL unless both are positive."""
    return F.when((now > 0) & (base > 0), F.ln(now / base) * 100)


def warm(value: Column, minutes: Column, width: int) -> Column:
    """0.0 until ``width`` minutes of the session have passed (NULL minutes too)."""
    return F.when(minutes >= width, value).otherwise(F.lit(0.0))


def rows(w: WindowSpec, n: int) -> WindowSpec:
    """The trailing frame of n rows ending at the current one."""
    return w.rowsBetween(-(n - 1), 0)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in floats}) if floats else df


def join_results(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """``a`` with the columns of ``b`` per group; without groups ``b`` is one row, read as a scalar."""
    if by:
        return a.join(b, list(by), "left")
    row = b.select(F.struct(*b.columns)).scalar()
    return a.withColumn("_row", row).select(*a.columns, "_row.*")
