"""Series sources: separated text files with decimal comma, parquet, datasets with a break date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesConfig:
    """What has to be known about a target before it can be forecast."""

    target: str
    dataset: str
    seasonal_periods: int
    stat_features: tuple[str, ...] = ()
    target_candidates: tuple[str, ...] = ()
    resample_weekly: bool = False
    break_date: dt.date | None = None
    condense: tuple[str, ...] = ()
    condensed_name: str | None = None
    several_gappy_columns: bool = True
    univariate_imputation: bool = False
    holiday_columns: tuple[str, ...] = ("public_holiday", "school_holiday")
    non_seasonal: tuple[str, ...] = ("mean_temp", "total_prec_height_mm", "total_sun_dur_h")


@dataclass(frozen=True)
class RunParameters:
    """Season and split lengths of one run; a split share of 0 asks for expanding folds."""

    seasonal_periods: int
    split_share: float | None
    initial_train: int | None
    test_length: int | None
    resample_weekly: bool = field(default=False)

    @staticmethod
    def of(config: SeriesConfig, split_share: float) -> RunParameters:
        season = config.seasonal_periods
        folds = split_share == 0
        return RunParameters(
            seasonal_periods=season // 7 if config.resample_weekly else season,
            split_share=None if folds else split_share,
            initial_train=2 * season if folds else None,
            test_length=season if folds else None,
            resample_weekly=config.resample_weekly)


def parse_date(col: Column) -> Column:
    """Day-first dates with dots, or ISO dates; NULL for anything else."""
    return F.coalesce(F.try_to_date(col, "dd.MM.yyyy"), F.try_to_date(col, "yyyy-MM-dd"))


def parse_number(col: Column) -> Column:
    """Decimal-comma numbers; the words true and false count as 1 and 0; NaN becomes NULL."""
    text = F.trim(col)
    flag = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0)
    number = F.regexp_replace(text, ",", ".").try_cast("double")
    return F.coalesce(flag, F.nanvl(number, F.lit(None).cast("double")))


def read_series_csv(spark: SparkSession, path: str, text_columns: Sequence[str] = ("public_holiday", "school_holiday"),
                    date_column: str | None = None, keys: Sequence[str] = (), time: str = "ds") -> DataFrame:
    """Read ``;``-separated text with a header; the first column is the date unless named."""
    raw = spark.read.csv(path, sep=";", header=True)
    date_column = date_column or raw.columns[0]
    plain = {*text_columns, *keys}
    out = [parse_date(F.col(f"`{date_column}`")).alias(time)]
    for name in raw.columns:
        if name == date_column:
            continue
        col = F.col(f"`{name}`")
        out.append(col if name in plain else parse_number(col).alias(name))
    return raw.select(*out)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def set_types(df: DataFrame, text_columns: Sequence[str], time: str = "ds", keep: Sequence[str] = ()) -> DataFrame:
    """Listed columns become strings, all others doubles; the date and key columns stay."""
    return df.select(*[
        F.col(c) if c == time or c in keep
        else F.col(c).cast("string" if c in text_columns else "double").alias(c)
        for c in df.columns])


def before_break(df: DataFrame, break_date: dt.date, time: str = "ds") -> DataFrame:
    return df.filter(F.col(time) < F.lit(break_date))


def load_datasets(df: DataFrame, name: str, break_date: dt.date | None = None, time: str = "ds") -> DataFrame:
    """The dataset under its name and, with a break date, a second one that ends before it.

    One pass over the rows: each row names the datasets it belongs to.
    """
    names = F.array(F.lit(name))
    if break_date is not None:
        both = F.array(F.lit(name), F.lit(f"{name}_before_break"))
        names = F.when(F.col(time) < F.lit(break_date), both).otherwise(names)
    return df.withColumn("dataset", F.explode(names))
