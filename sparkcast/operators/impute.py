"""Filling gaps. Fills are learned from train rows and used on all rows of the key.

Only columns with a gap among the train rows of a key are filled; gaps that occur in its test rows
alone stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.operators.chunks import attach
from sparkcast.operators.quantiles import wide_quantile


def train_rows(df: DataFrame) -> Column:
    return F.col("split") == "train" if "split" in df.columns else F.lit(True)


def fill_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Per key ``_fill_<column>``: the train mean or median, NULL where train has no gap."""
    train = df.filter(train_rows(df))
    gaps = {c: F.count_if(F.col(c).isNull()) > 0 for c in columns}
    if method == "mean":
        return train.groupBy(*keys).agg(*[
            F.when(gaps[c], F.avg(F.col(c).cast("double"))).alias(f"_fill_{c}") for c in columns])
    if method == "median":
        medians = wide_quantile(train, keys, columns, 0.5)
        flags = train.groupBy(*keys).agg(*[gaps[c].alias(f"_gap_{c}") for c in columns])
        return attach(flags, medians, keys).select(*keys, *[
            F.when(F.col(f"_gap_{c}"), F.col(c)).alias(f"_fill_{c}") for c in columns])
    raise ValueError(f"unknown fill {method!r}")


def impute_simple(df: DataFrame, keys: Sequence[str], columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Mean or median imputation."""
    filled = attach(df, fill_values(df, keys, columns, method), keys)
    return filled.select(*[
        F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def impute(df: DataFrame, keys: Sequence[str], columns: Sequence[str], method: str | None, time: str = "ds",
           **options) -> DataFrame:
    """Impute by name: mean, median, knn, iterative; None leaves the frame as it is."""
    if method is None or not columns:
        return df
    if method in ("mean", "median"):
        return impute_simple(df, keys, columns, method)
    if method == "knn":
        from sparkcast.operators.knn import impute_knn
        return impute_knn(df, keys, columns, time=time, **options)
    if method == "iterative":
        from sparkcast.operators.chained import impute_iterative
        return impute_iterative(df, keys, columns, time=time, **options)
    raise ValueError(f"unknown imputation {method!r}")
