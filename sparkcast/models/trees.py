"""Gradient-boosted trees: one model over all series, with the level of a series as a feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.models.gram import complete
from sparkcast.operators.chunks import attach
from sparkcast.session import scratch_folder


@dataclass(frozen=True)
class TreeConfig:
    """Learning rate, depth, share of rows per tree, trees, and the gain a split must bring."""

    learning_rate: float = 0.1
    max_depth: int = 3
    subsample: float = 1.0
    n_estimators: int = 10
    gamma: float = 0.0
    seed: int = 0


def _assembled(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str) -> tuple[DataFrame, list[str]]:
    level = df.filter(F.col("split") == "train").groupBy(*keys).agg(
        F.coalesce(F.avg(y), F.lit(0.0)).alias("series_level"))
    names = [*features, "series_level"]
    rows = attach(df, level, keys).filter(complete(names))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in names})
    return VectorAssembler(inputCols=names, outputCol="_x").transform(rows), names


def fit_trees(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, cfg: TreeConfig) -> GBTRegressionModel:
    scratch_folder(df.sparkSession)  # every tenth tree is written there, so the lineage stays short
    rows, _ = _assembled(df, keys, features, y)
    train = rows.filter((F.col("split") == "train") & F.col(y).isNotNull())
    return GBTRegressor(featuresCol="_x", labelCol=y, stepSize=cfg.learning_rate, maxDepth=cfg.max_depth,
                        subsamplingRate=cfg.subsample, maxIter=cfg.n_estimators, minInfoGain=float(cfg.gamma),
                        seed=cfg.seed, checkpointInterval=10).fit(train)


def predict_trees(df: DataFrame, model: GBTRegressionModel, keys: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """Add ``prediction``; rows with a missing feature have none."""
    rows, _ = _assembled(df, keys, features, y)
    scored = model.setPredictionCol("prediction").transform(rows).select(*keys, "t", "prediction")
    return df.join(scored, [*keys, "t"], "left")


def feature_importance(spark: SparkSession, model: GBTRegressionModel, features: Sequence[str]) -> DataFrame:
    """Features by importance, one row per feature of the model."""
    pairs = list(zip([*features, "series_level"], [float(v) for v in model.featureImportances.toArray()]))
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")


