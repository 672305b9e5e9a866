"""From raw rows to train and test sets: impute, add features, encode, resample, split, reduce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.models.pca import pca_transform
from sparkcast.operators.calendar import EVENT_LAGS, SPECIAL_DAYS, add_calendar_features
from sparkcast.operators.chunks import tick, with_ordinal
from sparkcast.operators.clean import (condense, drop_null_target, drop_other_targets, numeric_columns, one_hot,
                                       resample_weekly)
from sparkcast.operators.impute import impute
from sparkcast.operators.lags import LAGS, add_statistical_features
from sparkcast.operators.split import split
from sparkcast.session import cut_lineage
from sparkcast.sources.series import RunParameters, SeriesConfig

FEATURESETS = ("full", "cal", "stat", "none")
# Lags and widths for weekly series.
WEEKLY_LAGS = (1, 4)
WEEKLY_WIDTH = 4
WEEKLY_EXTRA_WIDTH = 2


def add_features(df: DataFrame, keys: Sequence[str], features: Sequence[str] = (), season: int = 0,
                 condense_columns: Sequence[str] = (), condensed_name: str | None = None, calendar: bool = True,
                 statistics: bool = True, event_lags: Sequence[int] = EVENT_LAGS,
                 special_days: Sequence[str] = SPECIAL_DAYS, lags: Sequence[int] = LAGS, width: int = 7,
                 width_seasonal: int = 7, width_weekday: int = 4, weekday_stats: bool = True,
                 non_seasonal: Sequence[str] = (), time: str = "ds") -> DataFrame:
    """Condensed columns, calendar features and statistical features of a regular daily frame."""
    if condense_columns and condensed_name:
        df = condense(df, condense_columns, condensed_name)
    if calendar:
        df = add_calendar_features(df, keys, time, event_lags=event_lags, special_days=special_days)
    if statistics:
        df = add_statistical_features(df, keys, tick(time), features, season, lags, width, width_seasonal,
                                      width_weekday, weekday_stats, non_seasonal, time)
    return df


def imputed_split(df: DataFrame, keys: Sequence[str], columns: Sequence[str], params: RunParameters,
                  imputation: str | None, time: str = "ds", **options) -> DataFrame:
    """Split and impute, nothing else."""
    rows = split(df, keys, params.split_share, params.initial_train, params.test_length, time)
    return impute(rows, [*keys, "fold"], columns, imputation, time, **options)


def prepare_dataset(df: DataFrame, keys: Sequence[str], config: SeriesConfig, params: RunParameters,
                    imputation: str | None = "mean", featureset: str = "full",
                    categories: Mapping[str, Sequence[str]] | None = None, reduction: str | None = None,
                    time: str = "ds", **impute_options) -> DataFrame:
    """Train and test rows with all features of a feature set, one frame with ``fold`` and ``split``.

    ``df`` is regular and daily. Fills come from the train rows of a fold, before and after feature
    building. ``categories`` lists the values of the holiday columns, so the schema is known up front.
    """
    if featureset not in FEATURESETS:
        raise ValueError(f"unknown feature set {featureset!r}")
    calendar, statistics = featureset in ("full", "cal"), featureset in ("full", "stat")
    weekly = config.resample_weekly
    by = [*keys, "fold"]
    helpers = ["t", "n_train", "split"]

    rows = split(df, keys, params.split_share, params.initial_train, params.test_length, time)
    raw = numeric_columns(df, exclude=[*keys, time, *config.holiday_columns])
    rows = impute(rows, by, raw, imputation, time, **impute_options)
    rows = cut_lineage(rows.drop(*helpers))
    rows = add_features(rows, by, config.stat_features, config.seasonal_periods, config.condense, config.condensed_name,
                        calendar, statistics and not weekly, non_seasonal=config.non_seasonal, time=time)
    encode = {c: (categories or {}).get(c, ()) for c in config.holiday_columns if c in rows.columns}
    rows = drop_null_target(one_hot(rows, encode), config.target)

    freq, initial, test = "D", params.initial_train, params.test_length
    if weekly:
        freq = "W"
        rows = resample_weekly(rows.drop("cal_date_weekday"), by, config.target_candidates, time)
        initial, test = (initial // 7, test // 7) if initial is not None else (None, None)
        if statistics:
            numbered = with_ordinal(rows, by, time, "_t", total=None, freq=freq)
            rows = add_statistical_features(
                numbered, by, "_t", config.stat_features, params.seasonal_periods, WEEKLY_LAGS, WEEKLY_WIDTH,
                WEEKLY_WIDTH, weekday_stats=False, non_seasonal=config.non_seasonal, time=time,
                extra_widths=(WEEKLY_EXTRA_WIDTH,)).drop("_t")
    rows = cut_lineage(drop_other_targets(rows, config.target_candidates, config.target))

    if params.split_share is not None:
        rows = split(rows.drop("fold"), keys, params.split_share, time=time, freq=freq)
    else:
        rows = with_ordinal(rows, by, time, "t", total=None, freq=freq)
        start = (F.lit(initial) + F.col("fold") * F.lit(test)).cast("long")
        rows = rows.withColumn("n_train", start).filter(F.col("t") < start + F.lit(test))
        rows = rows.withColumn("split", F.when(F.col("t") < start, "train").otherwise("test"))
    features = numeric_columns(rows, exclude=[*by, time, *helpers])
    rows = impute(rows, by, features, imputation, time, **impute_options)
    if reduction == "pca" and imputation is not None:
        rows = pca_transform(rows, by, [c for c in features if c != config.target])
    return rows
