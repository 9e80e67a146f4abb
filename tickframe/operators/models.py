"""Training and scoring with MLlib."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import count_if, join_results
from ..session import materialise, scratch_path
from .balance import align_features, attach_class_weight, class_weights, undersample_majority
from .metrics import classification_metrics
from .compare import fold_metrics
from .ranking import global_position
from .splits import chronological_split, fit_val_split, fold_ranges, rows_in_splits
from .trades import OUTCOME_COLUMNS, signals_at, trade_outcomes, trade_totals

# Training defaults.
MIN_FOLD_POSITIVES = 10
MIN_FOLD_SIGNALS = 3


@dataclass
class Artifact:
    """A fitted pipeline with what is needed to score and judge it."""

    model: PipelineModel
    features: list[str]
    threshold: float
    params: dict

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(os.path.join(path, "model"))
        side = json.dumps({"features": self.features, "threshold": self.threshold, "params": self.params})
        spark.createDataFrame([(side,)], "value string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "sidecar"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifact:
        side = json.loads(spark.read.text(os.path.join(path, "sidecar")).first()[0])
        return cls(PipelineModel.load(os.path.join(path, "model")), **side)


def fit(train: DataFrame, features: Sequence[str], params: dict | None = None, val: DataFrame | None = None,
        weight: str | None = None, target: str = "target") -> PipelineModel:
    """Boosted trees; with a validation part, boosting stops when it no longer improves."""
    settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **(params or {})}
    gbt = GBTClassifier(labelCol="label", featuresCol="features", **settings)
    if weight:
        gbt = gbt.setWeightCol(weight)
    cols = [*features, target, *([weight] if weight else [])]
    data = train.select(*cols).withColumn("is_val", F.lit(False))
    if val is not None:
        gbt = gbt.setValidationIndicatorCol("is_val")
        extra = val.select(*features, target, *([F.lit(1.0).alias(weight)] if weight else []))
        data = data.unionByName(extra.withColumn("is_val", F.lit(True)))
    data = align_features(data, features).withColumn("label", F.col(target).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt]).fit(data)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "proba") -> DataFrame:
    """P(class 1) per row; missing features count as 0.0."""
    filled = align_features(df, features)
    scored = model.transform(filled).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def train(df: DataFrame, features: Sequence[str], keys: Sequence[str], method: str = "undersample",
          threshold: float = 0.5, params: dict | None = None) -> tuple[Artifact, DataFrame]:
    """Split by date, balance the training part, fit, score all rows.

    Returns the artifact and the scored table with its split.
    """
    split = materialise(chronological_split(df), "split")
    fit_rows, weight = split.where(F.col("split") == "train"), None
    if method == "undersample":
        fit_rows = undersample_majority(fit_rows, keys)
    elif method == "class_weights":
        fit_rows, weight = attach_class_weight(fit_rows, class_weights(fit_rows)), "weight"
    model = fit(fit_rows, features, params, split.where(F.col("split") == "val"), weight)
    return Artifact(model, list(features), threshold, params or {}), score(model, split, features)


def evaluate(scored: DataFrame, threshold: float) -> DataFrame:
    return classification_metrics(scored, threshold, ["split"])


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature; features no tree used are 0."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)],
                                 "feature string, importance double")


def tune(df: DataFrame, features: Sequence[str], grid: dict[str, Sequence], metric: str = "precision",
         folds: int = 3, threshold: float = 0.5, ts: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """Mean metric per parameter set over expanding time folds.

    A fold with fewer than 10 training positives zeroes the whole trial; fewer
    than 3 signals zero that fold.  Rows are numbered in time order and written
    once; a fold is a range of numbers.  Each fit is distributed; the loop only
    walks parameters and folds.
    """
    placed = global_position(df.select(*features, "target", ts, *[c for c in tie if c not in (*features, "target", ts)]),
                             ts, tie, "_pos").drop(*[c for c in tie if c not in features])
    blocks = fold_ranges(placed.count(), folds)
    held = F.array(*[F.when((F.col("_pos") < start) & (F.col("target") == 1), 1).otherwise(0) for start, _ in blocks])
    counts = placed.select(F.posexplode(held)).groupBy("pos").agg(F.sum("col")).collect()  # one row per fold
    enough = len(counts) == folds and all(r[1] >= MIN_FOLD_POSITIVES for r in counts)
    trials = []
    for values in product(*grid.values()):
        params, scores = dict(zip(grid, values, strict=True)), []
        for start, end in blocks if enough else ():
            model = fit(placed.where(F.col("_pos") < start), features, params)
            scored = score(model, placed.where((F.col("_pos") >= start) & (F.col("_pos") < end)), features)
            n = scored.agg(count_if(F.col("proba") >= threshold).alias("signals"))
            row = join_results(classification_metrics(scored, threshold), n, ()).first()
            scores.append((row[metric] or 0.0) if row["signals"] >= MIN_FOLD_SIGNALS else 0.0)
        trials.append((json.dumps(params, sort_keys=True), float(sum(scores) / len(scores)) if scores else 0.0))
    return df.sparkSession.createDataFrame(trials, "params string, score double")


def walk_forward(df: DataFrame, features: Sequence[str], keys: Sequence[str], windows: DataFrame,
                 threshold: float = 0.67, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Refit per window and score its test range; returns (fold metrics with trade totals, scored test rows).

    The input is written once in ranges of dates, which the windows' scans prune.  The loop walks the windows, a few
    per year of data, and only fits: each model's test rows are appended to one long table (split_index, row),
    which is reduced per window at the end.  Trade totals come where the columns of trades are there.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "walk")
    base = materialise(df.repartitionByRange("date").sortWithinPartitions("date"), "walk-input")
    windows = materialise(windows, "windows")  # worked out once, and known to be small where it is joined
    positives = (rows_in_splits(base.select("date", "target"), windows, "train").groupBy("split_index")
                 .agg(count_if(F.col("target") == 1).alias("train_positives")))
    positives = materialise(windows.select("split_index").join(positives, "split_index", "left")
                            .fillna(0, ["train_positives"]), "positives")
    usable = windows.join(positives.where(F.col("train_positives") >= MIN_FOLD_POSITIVES), "split_index")
    schema = None
    needed = [*dict.fromkeys([*features, *keys, "target", "date"])]
    for w in usable.orderBy("split_index").collect():
        span = base.where(F.col("date").between(w["train_start"], w["train_end"])).select(*needed)
        parts = materialise(fit_val_split(span), "fit")
        model = fit(undersample_majority(parts.where(F.col("part") == "fit"), keys), features, params,
                    parts.where(F.col("part") == "val"))
        scored = score(model, base.where(F.col("date").between(w["test_start"], w["test_end"])), features)
        scored = scored.withColumn("split_index", F.lit(w["split_index"]).cast("long"))
        schema = scored.schema
        scored.write.mode("append").parquet(path)
    if schema is None:
        scored = df.limit(0).withColumn("proba", F.lit(0.0)).withColumn("split_index", F.lit(0).cast("long"))
    else:
        scored = spark.read.schema(schema).parquet(path)
    folds = fold_metrics(scored, threshold, train_positives=positives)
    if set(OUTCOME_COLUMNS) <= set(scored.columns):
        folds = folds.join(trade_totals(trade_outcomes(signals_at(scored, threshold)), ["split_index"]), "split_index", "left")
    return folds, scored
