"""The numbers behind exploratory plots: histograms, box plots, correlations, autocorrelations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.operators.chunks import attach, windowed, with_ordinal
from sparkcast.operators.clean import long_series
from sparkcast.operators.quantiles import exact_quantiles

# Two-sided normal quantiles for 95 and 99 percent.
Z95 = 1.959963984540054
Z99 = 2.5758293035489004


def correlation_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All pairs ``(a, b, r)``; a row counts for a pair when it has both values."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.groupBy(*keys).agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("r")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.a", "_c.b", "_c.r")


def histogram(df: DataFrame, keys: Sequence[str], columns: Sequence[str], bins: int | Sequence[float] = 10,
              time: str = "ds") -> DataFrame:
    """Counts per bin, empty bins included; the last bin holds its right edge."""
    ids = [*keys, "column"]
    long = long_series(df, keys, columns, time).drop(time)
    if isinstance(bins, int):
        span = long.groupBy(*ids).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        flat = F.col("_lo") == F.col("_hi")
        span = span.select(*ids, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                           F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
        edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.col("_hi")).otherwise(
            F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / F.lit(bins)))
        span = span.select(*ids, edges.alias("_edges"))
        count = bins
        rows = attach(long, span, ids)
    else:
        count = len(bins) - 1
        rows = long.withColumn("_edges", F.array(*[F.lit(float(b)) for b in bins]))
    edge, v = F.col("_edges"), F.col("value")
    tallies = rows.groupBy(*ids, "_edges").agg(F.array(*[
        F.count_if((v >= edge[i]) & ((v <= edge[i + 1]) if i == count - 1 else (v < edge[i + 1])))
        for i in range(count)]).alias("_n"))
    return tallies.select(*ids, "_edges", F.posexplode("_n").alias("bin", "n")).select(
        *ids, "bin", F.col("_edges")[F.col("bin")].alias("lower"),
        F.col("_edges")[F.col("bin") + 1].alias("upper"), "n")


def box_statistics(df: DataFrame, keys: Sequence[str], columns: Sequence[str], time: str = "ds") -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 interquartile ranges, and the number beyond."""
    ids = [*keys, "column"]
    quartiles = exact_quantiles(df, keys, columns, [0.25, 0.5, 0.75]).select(
        *ids, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    rows = attach(long_series(df, keys, columns, time), quartiles, ids)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    low, high, v = F.col("q1") - reach, F.col("q3") + reach, F.col("value")
    out = rows.groupBy(*ids, "q1", "median", "q3").agg(
        F.min(F.when(v >= low, v)).alias("_low"), F.max(F.when(v <= high, v)).alias("_high"),
        F.count_if((v < low) | (v > high)).alias("n_outliers"))
    return out.select(*ids, "q1", "median", "q3",
                      F.least(F.col("_low"), F.col("q1")).alias("whisker_low"),
                      F.greatest(F.col("_high"), F.col("q3")).alias("whisker_high"), "n_outliers")


def autocorrelation(df: DataFrame, keys: Sequence[str], column: str, max_lag: int, time: str = "ds",
                    freq: str = "D", block: int = 64) -> DataFrame:
    """``r(h)`` for h = 1..max_lag over the rows that have a value, with 95 and 99 percent bands."""
    rows = with_ordinal(df.select(*keys, time, F.col(column).cast("double").alias("_x")).dropna(subset=["_x"]),
                        keys, time, "_t", "_n", freq)
    moments = rows.groupBy(*keys).agg(F.avg("_x").alias("_mean"))
    centred = attach(rows, moments, keys).withColumn("_x", F.col("_x") - F.col("_mean")).drop("_mean", time)
    parts = []
    for start in range(1, max_lag + 1, block):
        lags = range(start, min(start + block, max_lag + 1))
        wide = windowed(centred, keys, "_t", lambda make, lags=lags: {
            f"_l{h}": F.col("_x") * F.lag("_x", h).over(make()) for h in lags}, back=lags[-1])
        sums = wide.groupBy(*keys).agg(
            F.sum(F.col("_x") * F.col("_x")).alias("_c0"), F.max("_n").alias("_n"),
            F.array(*[F.sum(f"_l{h}") for h in lags]).alias("_c"))
        parts.append(sums.select(*keys, "_c0", "_n", F.posexplode("_c").alias("_i", "_c"))
                     .filter(F.col("_i") + start < F.col("_n"))
                     .select(*keys, (F.col("_i") + start).alias("lag"),
                             F.try_divide(F.col("_c"), F.col("_c0")).alias("r"),
                             (F.lit(Z95) / F.sqrt("_n")).alias("band95"),
                             (F.lit(Z99) / F.sqrt("_n")).alias("band99")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
