"""Scaling and variance-stabilising transforms with statistics of the train rows, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.operators.chunks import attach
from sparkcast.operators.impute import train_rows


def scale_statistics(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Train mean ``_mean_<c>`` and population deviation ``_sd_<c>``, 1 for a constant column."""
    out = []
    for c in columns:
        sd = F.stddev_pop(c)
        out += [F.avg(c).alias(f"_mean_{c}"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"_sd_{c}")]
    return df.filter(train_rows(df)).groupBy(*keys).agg(*out)


def standardize(df: DataFrame, keys: Sequence[str], columns: Sequence[str], keep_statistics: bool = False) -> DataFrame:
    out = attach(df, scale_statistics(df, keys, columns), keys)
    out = out.withColumns({c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}") for c in columns})
    return out if keep_statistics else out.drop(*[f"_{s}_{c}" for c in columns for s in ("mean", "sd")])


def unstandardize(df: DataFrame, column: str, statistics_of: str | None = None) -> DataFrame:
    """Back to the raw scale, with the statistics kept by ``standardize``."""
    s = statistics_of or column
    return df.withColumn(column, F.col(column) * F.col(f"_sd_{s}") + F.col(f"_mean_{s}"))


def log_statistics(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``_zeros``: whether train holds a 0, so that 1 has to be added; negatives are an error."""
    low = F.min(column)
    return df.filter(train_rows(df)).groupBy(*keys).agg(
        F.when(low < 0, F.raise_error(F.lit("negative values for the log transform")).cast("boolean"))
        .otherwise(F.count_if(F.col(column) == 0) > 0).alias("_zeros"))


def log_transform(df: DataFrame, keys: Sequence[str], column: str, keep_statistics: bool = False) -> DataFrame:
    """``log(y + 1)`` for keys whose train rows hold a 0, ``log(y)`` for the others."""
    out = attach(df, log_statistics(df, keys, column), keys)
    out = out.withColumn(column, F.when(F.col("_zeros"), F.log1p(column)).otherwise(F.ln(column)))
    return out if keep_statistics else out.drop("_zeros")


def log_inverse(col: Column, zeros: Column) -> Column:
    return F.when(zeros, F.expm1(col)).otherwise(F.exp(col))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson transform (2000), its four branches by sign and lambda."""
    near_zero, near_two = F.abs(lam) < 1e-12, F.abs(lam - 2.0) < 1e-12
    above = F.when(near_zero, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    below = F.when(near_two, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, above).otherwise(below)


def yeo_johnson_inverse(z: Column, lam: Column) -> Column:
    near_zero, near_two = F.abs(lam) < 1e-12, F.abs(lam - 2.0) < 1e-12
    above = F.when(near_zero, F.expm1(z)).otherwise(F.pow(z * lam + 1.0, 1.0 / lam) - 1.0)
    below = F.when(near_two, -F.expm1(-z)).otherwise(1.0 - F.pow(1.0 - (2.0 - lam) * z, 1.0 / (2.0 - lam)))
    return F.when(z >= 0, above).otherwise(below)


def power_likelihoods(df: DataFrame, keys: Sequence[str], column: str, lambdas: Column) -> DataFrame:
    """Log likelihood per key and lambda; rows only feed partial sums, they are not shuffled."""
    x, lam = F.col(column), F.col("power")
    rows = (df.filter(train_rows(df) & x.isNotNull())
            .withColumn("power", F.explode(lambdas)))
    sums = rows.groupBy(*keys, "power").agg(
        F.count(F.lit(1)).alias("_n"), F.var_pop(yeo_johnson(x, lam)).alias("_var"),
        F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("_jac"))
    return sums.select(*keys, "power", (
        -F.col("_n") / 2.0 * F.ln("_var") + (lam - 1.0) * F.col("_jac")).alias("log_likelihood"))


def _best(likelihoods: DataFrame, keys: Sequence[str]) -> DataFrame:
    return likelihoods.groupBy(*keys).agg(
        F.max(F.struct("log_likelihood", "power")).getField("power").alias("power"))


def power_lambda(df: DataFrame, keys: Sequence[str], column: str, low: float = -2.0, high: float = 4.0,
                 steps: int = 24, refine: bool = True) -> DataFrame:
    """Maximum-likelihood lambda per key from a grid, and a second, finer grid around the best."""
    width = (high - low) / steps
    grid = F.array(*[F.lit(low + i * width) for i in range(steps + 1)])
    best = _best(power_likelihoods(df, keys, column, grid), keys)
    if not refine:
        return best
    around = F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda i: F.col("_at") + i * F.lit(width / 10))
    near = attach(df, best.withColumnRenamed("power", "_at"), keys)
    return _best(power_likelihoods(near, keys, column, around), keys)


def power_transform(df: DataFrame, keys: Sequence[str], column: str, lambdas: DataFrame | None = None,
                    keep_statistics: bool = False, **grid) -> DataFrame:
    """Yeo-Johnson with the best lambda of the train rows, then standardised."""
    lambdas = power_lambda(df, keys, column, **grid) if lambdas is None else lambdas
    out = attach(df, lambdas, keys).withColumn(column, yeo_johnson(F.col(column), F.col("power")))
    out = standardize(out, keys, [column], keep_statistics=True)
    return out if keep_statistics else out.drop("power", f"_mean_{column}", f"_sd_{column}")


def forward(df: DataFrame, keys: Sequence[str], column: str, kind: str | None) -> DataFrame:
    """Transform by name (``log``, ``pw`` or none), keeping what the inverse needs."""
    if kind == "log":
        return log_transform(df, keys, column, keep_statistics=True)
    if kind == "pw":
        return power_transform(df, keys, column, keep_statistics=True)
    return df


def backward(df: DataFrame, column: str, kind: str | None, outputs: Sequence[str]) -> DataFrame:
    """Inverse of ``forward`` for forecast columns; interval bounds are inverted themselves."""
    if kind == "log":
        return df.withColumns({c: log_inverse(F.col(c), F.col("_zeros")) for c in outputs})
    if kind == "pw":
        raw = {c: F.col(c) * F.col(f"_sd_{column}") + F.col(f"_mean_{column}") for c in outputs}
        return df.withColumns({c: yeo_johnson_inverse(v, F.col("power")) for c, v in raw.items()})
    return df
