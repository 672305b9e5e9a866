"""Result sinks: decimal-comma text for people, partitioned parquet for everything else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_results(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles as text with a decimal comma and a fixed number of digits."""
    return df.select(*[
        F.regexp_replace(F.format_string(f"%.{digits}f", F.col(f.name)), r"\.", ",").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def result_name(description: str, target: str, datasets: Sequence[str], imputations: Sequence[str | None],
                split_share: float | None, seasonal_periods: int, stamp: str,
                featuresets: Sequence[str] | None = None) -> str:
    """Descriptive name of a results file."""
    sets = "".join(f"-{d}" for d in datasets)
    filled = "imp" + "".join(f"_{i if i is not None else 'None'}" for i in imputations)
    features = "" if featuresets is None else "feat" + "".join(f"_{f}" for f in featuresets)
    share = str(split_share).replace(".", "")
    return f"{description}-{target}{sets}-{features}-{filled}-splitperc_{share}-SeasPer_{seasonal_periods}-{stamp}"


def write_results_csv(df: DataFrame, path: str) -> None:
    format_results(df).write.mode("overwrite").csv(path, sep=";", header=True)


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = ("algo", "target", "dataset")) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
