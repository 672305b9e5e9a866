"""Regular time axes, column and row clean-up, alignment of actuals and predictions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.operators.chunks import with_ordinal

STEPS = {"D": "interval 1 day", "W": "interval 7 days", "H": "interval 1 hour"}


def regularize(df: DataFrame, keys: Sequence[str], time: str = "ds", freq: str = "D") -> DataFrame:
    """One row per step between the first and last time of a key; inserted rows are NULL."""
    measures = [c for c in df.columns if c not in keys and c != time]
    spans = df.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    calendar = spans.select(*keys, F.explode(
        F.sequence("_first", "_last", F.expr(STEPS[freq]))).alias(time))
    return calendar.join(df, [*keys, time], "left").select(*keys, time, *measures)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_rows_by_dates(df: DataFrame, start: dt.date, end: dt.date, time: str = "ds") -> DataFrame:
    """Remove an inclusive range of dates; dates that are not there are no error."""
    return df.filter(~F.col(time).between(F.lit(start), F.lit(end)))


def condense(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Replace columns by their sum, NULL when one of them is NULL."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return df.withColumn(name, total).drop(*[c for c in columns if c != name])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def drop_other_targets(df: DataFrame, candidates: Sequence[str], target: str) -> DataFrame:
    return df.drop(*[c for c in candidates if c != target])


def drop_unpredicted(df: DataFrame, prediction: str = "prediction", dummy: float | None = None) -> DataFrame:
    """Keep pairs that have a prediction; ``dummy`` names a sentinel used by foreign frames."""
    keep = F.col(prediction).isNotNull()
    if dummy is not None:
        keep = keep & (F.col(prediction) != F.lit(dummy))
    return df.filter(keep)


def null_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long report ``(keys, column, n_null, has_null)`` from one aggregate."""
    wide = df.groupBy(*keys).agg(*[
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])
    return (wide.unpivot(list(keys), list(columns), "column", "n_null")
            .withColumn("has_null", F.col("n_null") > 0))


def zero_if_missing(col: Column) -> Column:
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(col.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def null_if_nan(df: DataFrame) -> DataFrame:
    """The package represents a missing value by NULL only; call this on foreign frames."""
    return df.select(*[
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def reset_index(df: DataFrame, keys: Sequence[str], time: str = "ds", name: str = "t", freq: str = "D") -> DataFrame:
    """Replace the date by the row number within the key."""
    return with_ordinal(df, keys, time, name, total=None, freq=freq).drop(time)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude]


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that equal an earlier column in every row, NULL being equal to NULL; one pass."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    pairs = [(a, b) for a, b in combinations(columns, 2) if kinds[a] == kinds[b]]
    flags = df.agg(*[
        F.coalesce(F.bool_and(F.col(a).eqNullSafe(F.col(b))), F.lit(True)).alias(f"_{i}")
        for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(b).alias("column"), F.col(f"_{i}").alias("same"))
                     for i, (_, b) in enumerate(pairs)])
    return (flags.select(F.explode(rows).alias("r")).filter("r.same")
            .select("r.column").distinct())


def null_free_columns(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> list[str]:
    """Names of columns without NULL among the train rows; one aggregate, one row to the driver."""
    rows = df if train is None else df.filter(train)
    first = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if first[c] == 0]


def drop_null_features(df: DataFrame, features: Sequence[str], train: Column | None = None) -> DataFrame:
    kept = set(null_free_columns(df, features, train))
    return df.drop(*[c for c in features if c not in kept])


def align(actual: DataFrame, prediction: DataFrame, keys: Sequence[str], time: str = "ds") -> DataFrame:
    """Actuals next to predictions of the same key and time."""
    return actual.join(prediction, [*keys, time], "inner")


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def long_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str], time: str = "ds") -> DataFrame:
    """Long ``(keys, time, column, value)`` without NULLs, the data behind line and scatter plots."""
    return (df.select(*keys, time, *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot([*keys, time], list(columns), "column", "value").dropna(subset=["value"]))


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Indicator columns ``<column>_<value>`` in place of the column; NULL sets none of them."""
    new = [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
           for c, values in categories.items() for v in sorted(values)]
    return df.select(*[F.col(c) for c in df.columns if c not in categories], *new)


def categories_of(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Distinct values of category columns, which become column names; more than ``limit`` is an error."""
    found: dict[str, list[str]] = {}
    for c in columns:
        rows = df.select(c).dropna().distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{c} has more than {limit} values; it is no category column")
        found[c] = sorted(str(r[0]) for r in rows)
    return found


def resample_weekly(df: DataFrame, keys: Sequence[str], sum_columns: Sequence[str], time: str = "ds",
                    drop_incomplete: bool = True) -> DataFrame:
    """Weeks that end on Sunday: listed columns summed, all others averaged.

    A summed week without any value is 0; weeks with a NULL average are dropped. Weeks inside the
    span of a key that have no row at all would be all NULL, so they need no row either.
    """
    measures = [c for c in df.columns if c not in keys and c != time]
    week = F.next_day(F.date_sub(F.col(time), 1), "Sun")
    out = df.groupBy(*keys, week.alias(time)).agg(*[
        F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) if c in sum_columns
        else F.avg(F.col(c).cast("double")).alias(c) for c in measures])
    return out.dropna(subset=measures) if drop_incomplete and measures else out
