"""Naive forecasts every model is compared with.

All functions take a split frame (``t, n_train, split`` per key) with the target ``y`` and add columns.
A row without a forecast is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.operators.chunks import attach, running_sums, windowed

def is_train() -> Column:
    return F.col("split") == "train"


def one_step_baselines(df: DataFrame, keys: Sequence[str], y: str, season: int) -> DataFrame:
    """Random walk, seasonal random walk and historical average, each from all rows before a row.

    Within train the historical average is the train average.
    """
    def build(make):
        return {"RW": F.lag(y, 1).over(make()), "seasRW": F.lag(y, season).over(make())}

    out = windowed(df, keys, "t", build, back=max(1, season))
    return historical_average(out, keys, y, one_step=True)


def random_walk(df: DataFrame, keys: Sequence[str], y: str, season: int = 1, name: str = "prediction") -> DataFrame:
    return windowed(df, keys, "t", lambda make: {name: F.lag(y, season).over(make())}, back=season)


def naive_fixed(df: DataFrame, keys: Sequence[str], y: str, name: str = "prediction") -> DataFrame:
    """The last train value for all test rows, the previous value within train."""
    last = df.groupBy(*keys).agg(F.max(F.when(is_train(), F.struct("t", y))).alias("_last"))
    out = windowed(df, keys, "t", lambda make: {"_before": F.lag(y, 1).over(make())}, back=1)
    return (attach(out, last, keys)
            .withColumn(name, F.when(is_train(), F.col("_before")).otherwise(F.col(f"_last.{y}")))
            .drop("_before", "_last"))


def seasonal_naive_fixed(df: DataFrame, keys: Sequence[str], y: str, season: int, name: str = "prediction") -> DataFrame:
    """The last season of train over and over for the test rows, one season back within train."""
    length = F.least(F.lit(season), F.col("n_train"))
    ahead = F.col("t") - F.col("n_train")
    source = F.when(is_train(), F.col("t") - F.lit(season)).otherwise(
        F.col("n_train") - length + F.pmod(ahead, length))
    values = df.filter(is_train()).select(*keys, F.col("t").alias("_source"), F.col(y).alias(name))
    return df.withColumn("_source", source).join(values, [*keys, "_source"], "left").drop("_source")


def historical_average(df: DataFrame, keys: Sequence[str], y: str, one_step: bool = True, name: str = "HA") -> DataFrame:
    """The train average, or for test rows the average of all rows before when one step ahead."""
    value, known = F.col(y).cast("double"), F.col(y).isNotNull().cast("double")
    if not one_step:
        mean = df.groupBy(*keys).agg(F.avg(F.when(is_train(), value)).alias(name))
        return attach(df, mean, keys)
    out = running_sums(df, keys, "t", {"_sum": value, "_seen": known}, whole={
        "_train_sum": F.when(is_train(), value), "_train_seen": F.when(is_train(), known)})
    expanding = F.try_divide(F.col("_sum"), F.col("_seen"))
    mean = F.try_divide(F.col("_train_sum"), F.col("_train_seen"))
    return (out.withColumn(name, F.when(is_train(), mean).otherwise(expanding))
            .drop("_sum", "_seen", "_train_sum", "_train_seen"))


def long_predictions(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str], time: str = "ds") -> DataFrame:
    """Wide forecasts to ``(keys, time, split, model, actual, prediction)``."""
    ids = [*keys, time, "split", "actual"]
    wide = df.withColumn("actual", F.col(y)).select(*ids, *models)
    return wide.unpivot(ids, list(models), "model", "prediction")
