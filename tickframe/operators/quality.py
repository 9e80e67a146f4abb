"""Record validation, deduplication and schema drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RuleSet:
    """What a record of one source must satisfy."""

    required: frozenset[str]
    positive: frozenset[str] = field(default_factory=frozenset)
    source: str | None = None
    not_negative: frozenset[str] = field(default_factory=frozenset)


# Rule sets per source.
_OHLC = frozenset({"open", "high", "low", "close"})
RULES: Mapping[str, RuleSet] = {
    "spy": RuleSet(_OHLC | {"timestamp", "volume", "vwap", "source"}, _OHLC | {"volume"}, "spy"),
    "equity": RuleSet(_OHLC | {"timestamp", "volume", "vwap", "source"}, _OHLC | {"volume"}),
    "options": RuleSet(_OHLC | {"timestamp", "volume", "source"}, _OHLC, "options"),
    "vix": RuleSet(_OHLC | {"timestamp", "source"}, _OHLC, "vix"),
    "news": RuleSet(frozenset({"timestamp", "title", "source"}), frozenset(), "news"),
}


def zero_allowed(source: str) -> RuleSet:
    """The rules of ``source`` for measures of which 0 is a value, unlike a price: only negative ones are refused."""
    rules = RULES[source]
    return replace(rules, positive=rules.positive - _OHLC, not_negative=rules.positive & _OHLC)


def validation_errors(df: DataFrame, rules: RuleSet) -> Column:
    """array<string>: missing fields (sorted), timestamp, positives and negatives (sorted), source."""
    present = set(df.columns)
    checks: list[Column] = []
    for c in sorted(rules.required):
        gap = F.col(c).isNull() if c in present else F.lit(True)
        checks.append(F.when(gap, F.lit(f"missing:{c}")))
    if "timestamp" in present and not isinstance(df.schema["timestamp"].dataType, T.StringType):
        checks.append(F.when(F.col("timestamp") <= 0, F.lit("not_positive:timestamp")))
    for c in sorted(rules.positive & present):
        checks.append(F.when(F.col(c) <= 0, F.lit(f"not_positive:{c}")))
    for c in sorted(rules.not_negative & present):
        checks.append(F.when(F.col(c) < 0, F.lit(f"negative:{c}")))
    if rules.source and "source" in present:
        checks.append(F.when(F.col("source") != rules.source, F.lit("unexpected:source")))
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, source: str | RuleSet) -> DataFrame:
    """The input with an ``errors`` array by the rules of a source, or by others; empty means valid."""
    return df.withColumn("errors", validation_errors(df, source if isinstance(source, RuleSet) else RULES[source]))


def split_valid(df: DataFrame, source: str | RuleSet) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, source)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def strict_bar_ok(required: Sequence[str] = ("timestamp", "open", "high", "low", "close")) -> Column:
    """Required fields present, timestamp and prices positive."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    for c in ("timestamp", "open", "high", "low", "close"):
        ok = ok & (F.col(c) > 0)
    return F.coalesce(ok, F.lit(False))


def dedup_last(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The last arrival per key.

    ``row_number() = 1`` lets Spark keep one row per key and map task before the
    shuffle, so a key repeated in a third of the table stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in arrival])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def schema_fields(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def schema_drift(spark: SparkSession, current: T.StructType, baseline: Mapping[str, str] | None,
                 new_columns: bool = True, missing_columns: bool = True,
                 type_changes: bool = True) -> DataFrame:
    """Alerts (kind, column, expected, actual) of a schema against a stored baseline.

    Reads metadata only.  Without a baseline there is nothing to compare yet.
    """
    now = schema_fields(current)
    alerts: list[tuple[str, str, str | None, str | None]] = []
    if baseline is not None:
        if new_columns:
            alerts += [("new_column", c, None, now[c]) for c in sorted(now.keys() - baseline.keys())]
        if missing_columns:
            alerts += [("missing_column", c, baseline[c], None) for c in sorted(baseline.keys() - now.keys())]
        if type_changes:
            alerts += [("type_change", c, baseline[c], now[c])
                       for c in sorted(now.keys() & baseline.keys()) if now[c] != baseline[c]]
    return spark.createDataFrame(alerts, "kind string, column string, expected string, actual string")
