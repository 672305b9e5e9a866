"""Scores of models next to the baselines, and results with one row per dataset and configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.operators import baselines
from sparkcast.operators.metrics import METRICS, score

BASELINES = ("RW", "seasRW", "HA")
# Metric names in result columns.
RESULT_NAMES = {"rmse": "RMSE", "mape": "MAPE", "smape": "sMAPE"}


def baseline_predictions(df: DataFrame, keys: Sequence[str], y: str, season: int) -> DataFrame:
    wide = baselines.one_step_baselines(df, keys, y, season)
    return baselines.long_predictions(wide, keys, y, BASELINES)


def evaluate(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Errors per group, split and model from long ``(split, model, actual, prediction)`` rows."""
    return score(predictions, [*by, "split", "model"])


def leaderboard(scores: DataFrame, by: Sequence[str], models: Sequence[str] = ("", *BASELINES)) -> DataFrame:
    """One row per group with a column ``<METRIC>_<Split>[_<model>]`` for each model; '' is the model itself."""
    out = []
    for m in models:
        for split, shown in (("train", "Train"), ("test", "Test")):
            here = (F.col("split") == split) & (F.col("model") == m)
            for metric in METRICS:
                name = f"{RESULT_NAMES[metric]}_{shown}" + (f"_{m}" if m else "")
                out.append(F.max(F.when(here, F.col(metric))).alias(name))
    return scores.groupBy(*by).agg(*out)
