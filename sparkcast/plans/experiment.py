"""Hyper-parameter runs: prepared rows, models for all configurations, errors, results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.models import linear
from sparkcast.models.evaluate import BASELINES, baseline_predictions, evaluate, leaderboard
from sparkcast.models.gram import complete
from sparkcast.models.pca import pca_transform
from sparkcast.operators.clean import numeric_columns
from sparkcast.operators.metrics import cv_summary, mean_over_folds, score
from sparkcast.operators.split import shuffle_cv, timeseries_cv
from sparkcast.plans.prepare import prepare_dataset
from sparkcast.session import cut_lineage
from sparkcast.sources.series import RunParameters, SeriesConfig

# Fixed value: dataset name of runs that failed.
FAILURE = "Failure"


def linear_predictions(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str,
                       configs: Sequence[linear.LinearConfig], one_step: bool = True,
                       models: DataFrame | None = None) -> DataFrame:
    """Long ``(keys, t, cfg_id, split, actual, prediction)``: in-sample for train, forecasts for test."""
    models = linear.fit(df, keys, features, y, configs) if models is None else models
    scored = linear.predict(df.filter(complete(features)), models, keys, features)
    columns = [*keys, "t", "cfg_id", "split", F.col(y).alias("actual"), "prediction"]
    if not one_step:
        return scored.select(*columns)
    rolled = linear.rolling_origin(df, keys, features, y, configs)
    return scored.filter(F.col("split") == "train").select(*columns).unionByName(rolled.select(*columns))


def run_linear(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, season: int,
               configs: Sequence[linear.LinearConfig], one_step: bool = True) -> DataFrame:
    """One result row per dataset (the keys) and configuration: 24 errors and the status of the run.

    A failed configuration has NULL errors and the dataset name ``Failure``.
    """
    models = cut_lineage(linear.fit(df, keys, features, y, configs))
    predictions = linear_predictions(df, keys, features, y, configs, one_step, models)
    own = evaluate(predictions.withColumn("model", F.lit("")), [*keys, "cfg_id"])
    mine = leaderboard(own, [*keys, "cfg_id"], [""])
    theirs = leaderboard(evaluate(baseline_predictions(df, keys, y, season), keys), keys, BASELINES)
    status = models.select(*keys, "cfg_id", "status")
    failed = F.col("status") != "ok"
    errors = [c for c in [*mine.columns, *theirs.columns] if c not in (*keys, "cfg_id")]
    out = status.join(mine, [*keys, "cfg_id"], "left").join(theirs, list(keys), "left")
    return out.select(
        F.when(failed, FAILURE).otherwise(F.concat_ws("/", *[F.col(k).cast("string") for k in keys])).alias("dataset"),
        *keys, "cfg_id", "status", *[F.when(~failed, F.col(c)).alias(c) for c in errors])


def results_over_folds(results: DataFrame, by: Sequence[str] = ("series_id", "cfg_id")) -> DataFrame:
    """Errors averaged over folds; a fold without a value leaves none."""
    errors = [c for c in results.columns if c.split("_")[0] in ("RMSE", "MAPE", "sMAPE")]
    return mean_over_folds(results, by, errors)


def cross_validate(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, cfg: linear.LinearConfig,
                   one_step: bool = True, folds: int = 3, draws: int = 5, shuffled: bool = False) -> DataFrame:
    """Errors over chronological folds, or over random draws, per key; short keys have none.

    ``df`` holds the rows to validate on, usually the train rows of a split.
    """
    rows = df.drop("t", "n_train", "split", "fold")
    by = [*keys, "fold"]
    if shuffled:
        cut = shuffle_cv(rows, keys, draws)
        predictions = linear_predictions(cut, by, features, y, [cfg], one_step=False)
    else:
        cut = timeseries_cv(rows, keys, folds)
        predictions = linear_predictions(cut, by, features, y, [cfg], one_step)
    scores = score(predictions.filter(F.col("split") == "test"), by)
    return cv_summary(scores, keys, draws if shuffled else folds, "shuf" if shuffled else "ts")


def run_models(df: DataFrame, keys: Sequence[str], y: str, season: int,
               runs: Mapping[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Result rows of any models: each run adds ``prediction`` to the split frame ``df``.

    A run that fails is recorded with NULL errors and the dataset name ``Failure``; the others go on.
    """
    done, failed = [], []
    for cfg_id, forecast in runs.items():
        try:
            rows = forecast(df).select(*keys, "t", "split", F.col(y).alias("actual"), "prediction")
            done.append(cut_lineage(rows.withColumn("cfg_id", F.lit(cfg_id))))
        except (PySparkException, ValueError, ArithmeticError) as error:
            failed.append((cfg_id, type(error).__name__))
    theirs = leaderboard(evaluate(baseline_predictions(df, keys, y, season), keys), keys, BASELINES)
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    parts = []
    if done:
        own = evaluate(reduce(DataFrame.unionByName, done).withColumn("model", F.lit("")), [*keys, "cfg_id"])
        parts.append(leaderboard(own, [*keys, "cfg_id"], [""]).join(theirs, list(keys), "left")
                     .withColumn("status", F.lit("ok")).withColumn("dataset", name))
    for cfg_id, reason in failed:
        parts.append(theirs.select(*keys).withColumns({
            "cfg_id": F.lit(cfg_id), "status": F.lit(f"failed: {reason}"), "dataset": F.lit(FAILURE)}))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select("dataset", *keys, "cfg_id", "status",
                      *[c for c in out.columns if c not in ("dataset", *keys, "cfg_id", "status")])


def optimize_linear(df: DataFrame, keys: Sequence[str], config: SeriesConfig, params: RunParameters,
                    configs: Sequence[linear.LinearConfig], imputations: Sequence[str | None] = ("mean",),
                    featuresets: Sequence[str] = ("full",), reductions: Sequence[str | None] = (None,),
                    categories: Mapping[str, Sequence[str]] | None = None, one_step: bool = True) -> DataFrame:
    """A whole optimisation run: every sensible way to prepare the data, every model configuration.

    A prepared dataset is written once and used by all configurations, which are fitted together.
    Errors are averaged over folds.
    """
    results, by = [], [*keys, "fold"]
    for imputation, featureset in product(imputations, featuresets):
        if not config.several_gappy_columns and featureset in ("cal", "none") and imputation in ("iterative", "knn"):
            continue
        prepared = cut_lineage(prepare_dataset(df, keys, config, params, imputation, featureset, categories))
        plain = numeric_columns(prepared, [*by, "ds", "t", "n_train", config.target])
        for reduction in reductions:
            rows, features = prepared, plain
            if reduction == "pca":
                if featureset == "none" or imputation is None:
                    continue
                rows = pca_transform(prepared, by, plain)
                features = [c for c in rows.columns if c.startswith("PC")]
                # components a fold does not need are constant
                rows = rows.withColumns({c: F.when(F.col("n_components").isNotNull(), F.coalesce(c, F.lit(0.0)))
                                         for c in features})
                rows = cut_lineage(rows)
            rows = rows.withColumns({c: F.col(c).cast("double") for c in features})
            scores = run_linear(rows, by, features, config.target, params.seasonal_periods, configs, one_step)
            over = results_over_folds(scores, [*keys, "cfg_id"])
            results.append(over.select(
                *keys, F.lit(imputation).alias("imputation"), F.lit(featureset).alias("featureset"),
                F.lit(reduction).alias("dim_reduction"), "cfg_id", *[c for c in over.columns if c not in (*keys, "cfg_id")]))
    return reduce(DataFrame.unionByName, results)
