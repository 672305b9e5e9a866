"""Chronological splits and cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.operators.chunks import with_ordinal


def _train_or_test(is_train: Column) -> Column:
    return F.when(is_train, "train").otherwise("test")


def percentage_split(df: DataFrame, keys: Sequence[str], share: float, time: str = "ds", freq: str = "D") -> DataFrame:
    """The first ``int(n * share)`` rows of a key are train. Adds ``t, n_train, fold, split``."""
    out = with_ordinal(df, keys, time, "t", "_n", freq)
    out = out.withColumn("n_train", F.floor(F.col("_n").cast("double") * F.lit(float(share))).cast("long"))
    return out.withColumns({
        "fold": F.lit(0), "split": _train_or_test(F.col("t") < F.col("n_train"))}).drop("_n")


def expanding_split(df: DataFrame, keys: Sequence[str], initial_train: int, test_length: int, time: str = "ds",
                    freq: str = "D", all_folds: bool = False) -> DataFrame:
    """Train sets that grow by one test length per fold; the last test set may be short.

    There are ``ceil(n / (initial + test))`` folds, with ``all_folds`` as many as have a test row.
    A row is repeated once per fold that uses it, so keep statistics keyed by ``keys + fold``.
    """
    out = with_ordinal(df, keys, time, "t", "_n", freq)
    if all_folds:
        folds = F.ceil((F.col("_n") - F.lit(initial_train)) / F.lit(test_length))
    else:
        folds = F.ceil(F.col("_n") / F.lit(initial_train + test_length))
    first = F.greatest(F.lit(0), F.floor((F.col("t") - F.lit(initial_train)) / F.lit(test_length))).cast("int")
    last = folds.cast("int") - 1
    out = out.withColumn("fold", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<int>"))))
    out = out.withColumn("n_train", (F.lit(initial_train) + F.col("fold") * F.lit(test_length)).cast("long"))
    return out.withColumn("split", _train_or_test(F.col("t") < F.col("n_train"))).drop("_n")


def test_folds(df: DataFrame, keys: Sequence[str], initial_train: int, test_length: int, time: str = "ds",
               freq: str = "D", all_folds: bool = False) -> DataFrame:
    """The folds of ``expanding_split`` without repeating a row: ``fold`` is where a row is tested.

    A row is a test row of at most one fold; rows that only ever train have none. One-step-ahead
    forecasts use all earlier rows whatever the fold, so scoring them needs nothing else, and the
    size stays that of the series where repeated train rows would grow with its square.
    """
    out = with_ordinal(df, keys, time, "t", "_n", freq)
    tested = F.floor((F.col("t") - F.lit(initial_train)) / F.lit(test_length)).cast("int")
    inside = F.col("t") >= F.lit(initial_train)
    if not all_folds:
        inside = inside & (tested < F.ceil(F.col("_n") / F.lit(initial_train + test_length)))
    return out.withColumn("fold", F.when(inside, tested)).drop("_n")


def split(df: DataFrame, keys: Sequence[str], share: float | None, initial_train: int | None = None,
          test_length: int | None = None, time: str = "ds", freq: str = "D") -> DataFrame:
    """A percentage split, or expanding folds when there is no share."""
    if share is not None:
        return percentage_split(df, keys, share, time, freq)
    return expanding_split(df, keys, initial_train, test_length, time, freq)


def timeseries_cv(df: DataFrame, keys: Sequence[str], folds: int = 3, time: str = "ds", freq: str = "D",
                  min_rows: int = 80) -> DataFrame:
    """``folds`` validation blocks of ``n div (folds + 1)`` rows, each after all rows before it.

    The remainder goes to the first train set; keys with fewer than ``min_rows`` rows have no folds.
    """
    out = with_ordinal(df, keys, time, "t", "_n", freq).filter(F.col("_n") >= F.lit(min_rows))
    block = F.floor(F.col("_n") / F.lit(folds + 1))
    start = F.col("_n") - F.lit(folds) * block
    first = F.greatest(F.lit(0), F.floor((F.col("t") - start) / block)).cast("int")
    out = out.withColumn("fold", F.explode(F.sequence(first, F.lit(folds - 1))))
    out = out.withColumn("n_train", (start + F.col("fold") * block).cast("long"))
    return out.withColumn("split", _train_or_test(F.col("t") < F.col("n_train"))).drop("_n")


def shuffle_cv(df: DataFrame, keys: Sequence[str], draws: int = 5, share: float = 0.2, seed: int = 0,
               time: str = "ds", freq: str = "D", min_rows: int = 80) -> DataFrame:
    """Random validation rows, ``ceil(share * n)`` per draw, the same ones in every run.

    The rows with the smallest hash are drawn. The hash range is cut into as many slices as the key
    has thousands of rows, so that only the slice with the threshold has to be ordered.
    """
    out = with_ordinal(df, keys, time, "t", "_n", freq).filter(F.col("_n") >= F.lit(min_rows))
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    out = out.withColumn("_h", F.md5(F.concat_ws("/", "t", "fold", F.lit(seed))))
    slices = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(1000)))
    unit = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    out = out.withColumn("_slice", F.floor(unit * slices))
    ranked = rank_in_slices(out, [*keys, "fold"], "_slice", ["_h", "t"])
    return ranked.withColumn("split", _train_or_test(
        F.col("_rank") > F.ceil(F.col("_n").cast("double") * F.lit(float(share))))).drop("_rank", "_n", "_h", "_slice")


def rank_in_slices(df: DataFrame, keys: Sequence[str], slice_column: str, order: Sequence[str]) -> DataFrame:
    """Row number over ``order`` for keys already cut into ordered slices."""
    counts = df.groupBy(*keys, slice_column).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, slice_column, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, slice_column).orderBy(*order)
    return (df.join(offsets, [*keys, slice_column], "inner")
            .withColumn("_rank", F.row_number().over(inside) + F.col("_before")).drop("_before"))


def validation_cut(df: DataFrame, keys: Sequence[str], share: float = 0.8, time: str = "ds", freq: str = "D") -> DataFrame:
    """Split the train rows of a split frame once more, the last ones becoming ``valid``."""
    train = df.filter(F.col("split") == "train").drop("t", "n_train")
    out = with_ordinal(train, keys, time, "t", "_n", freq)
    cut = F.floor(F.col("_n").cast("double") * F.lit(float(share)))
    return out.withColumn("split", F.when(F.col("t") < cut, "train").otherwise("valid")).drop("_n")


def last_season(df: DataFrame, season: int) -> DataFrame:
    """The last ``season`` train rows of a split frame."""
    return df.filter((F.col("split") == "train") & (F.col("t") >= F.col("n_train") - F.lit(season)))


