"""Forecast errors. Pairs without a prediction are left out; a missing actual makes the error NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("rmse", "mape", "smape")


def _checked(value: Column, actual: Column, used: Column, strict: bool) -> Column:
    missing = F.count_if(used & actual.isNull()) > 0
    if strict:
        return F.when(missing, F.raise_error(F.lit("missing values in the actuals")).cast("double")).otherwise(value)
    return F.when(~missing, value)


def metric_columns(actual: str = "actual", prediction: str = "prediction", strict: bool = False) -> dict[str, Column]:
    """RMSE, MAPE (0.1 added to the divisor) and sMAPE (0/0 counts as no error) as aggregates."""
    a, p = F.col(actual), F.col(prediction)
    used = p.isNotNull()
    size = (F.abs(a) + F.abs(p)) / F.lit(2.0)
    n = F.count_if(used)
    share = F.coalesce(F.sum(F.try_divide(F.abs(p - a), size)), F.when(n > 0, F.lit(0.0)))
    values = {
        "rmse": F.sqrt(F.avg(F.pow(p - a, F.lit(2.0)))),
        "mape": F.avg(F.abs(F.try_divide(a - p, a + F.lit(0.1)))) * F.lit(100.0),
        "smape": F.try_divide(share * F.lit(100.0), n),
    }
    return {name: _checked(v, a, used, strict) for name, v in values.items()}


def score(df: DataFrame, by: Sequence[str], actual: str = "actual", prediction: str = "prediction",
          strict: bool = False, metrics: Sequence[str] = METRICS) -> DataFrame:
    """All metrics and the number of scored pairs per group in one aggregate."""
    columns = metric_columns(actual, prediction, strict)
    return df.groupBy(*by).agg(*[columns[m].alias(m) for m in metrics],
                               F.count_if(F.col(prediction).isNotNull()).alias("n_scored"))


def mean_over_folds(scores: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Average per group; one fold without a value leaves none."""
    return scores.groupBy(*by).agg(*[
        F.when(F.count(m) == F.count(F.lit(1)), F.avg(m)).alias(m) for m in metrics])


def cv_summary(scores: DataFrame, by: Sequence[str], folds: int, prefix: str = "ts",
               metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean, population deviation and the single values of all folds that could be scored."""
    ok = scores.dropna(subset=list(metrics))
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{prefix}_cv_{m}_mean"), F.stddev_pop(m).alias(f"{prefix}_cv_{m}_std")]
        out += [F.max(F.when(F.col("fold") == i, F.col(m))).alias(f"{prefix}_cv_{m}_{i}") for i in range(folds)]
    return ok.groupBy(*by).agg(*out)


def with_interval(df: DataFrame, width: Column | float, prediction: str = "prediction") -> DataFrame:
    """A symmetric interval of the given half width around the prediction."""
    half = width if isinstance(width, Column) else F.lit(float(width))
    return df.withColumns({"lower_conf": F.col(prediction) - half, "upper_conf": F.col(prediction) + half})


def interval_coverage(df: DataFrame, by: Sequence[str], actual: str = "actual") -> DataFrame:
    """Share of actuals inside the prediction interval."""
    known = F.col(actual).isNotNull() & F.col("lower_conf").isNotNull() & F.col("upper_conf").isNotNull()
    inside = F.col(actual).between(F.col("lower_conf"), F.col("upper_conf"))
    return df.filter(known).groupBy(*by).agg(
        F.avg(inside.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_scored"))


def best_runs(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("dataset",), run: str = "run") -> DataFrame:
    """The first run with the smallest value per group and metric; a missing value is never best."""
    long = results.select(*by, run, *metrics).unpivot([*by, run], list(metrics), "metric", "value")
    return (long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(*by, "metric")
            .agg(F.min(F.struct("value", run)).alias("_best"))
            .select(*by, "metric", f"_best.{run}", "_best.value"))
