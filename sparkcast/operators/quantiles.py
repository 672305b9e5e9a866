"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.operators.chunks import attach
from sparkcast.session import cut_lineage

SLICES = 64


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float],
                    slices: int = SLICES) -> DataFrame:
    """Linearly interpolated quantiles: one row ``(keys, column, n, q array)`` per key and column.

    Equal values are counted together first. A sketch then only proposes where to cut the values of a
    key into ``slices``, a power of two; ranks come from exact counts, so no task holds a whole key and the result does
    not depend on the sketch. The cuts are checkpointed: a repeated task must see the same ones.
    """
    ids = [*keys, "column"]
    long = (df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(list(keys), list(columns), "column", "value").dropna(subset=["value"]))
    counts = long.groupBy(*ids, "value").agg(F.count(F.lit(1)).alias("_c"))
    steps = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = cut_lineage(counts.groupBy(*ids).agg(
        F.percentile_approx("value", steps, F.lit(1000)).alias("_cuts"), F.sum("_c").alias("n")))
    sliced = attach(counts, cuts, ids).withColumn("_slice", F.lit(0))
    step = slices // 2
    while step:  # bisection: the number of cuts below the value
        below = F.get("_cuts", F.col("_slice") + F.lit(step - 1)) < F.col("value")
        sliced = sliced.withColumn("_slice", F.col("_slice") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    sliced = sliced.drop("_cuts")
    per_slice = sliced.groupBy(*ids, "_slice").agg(F.sum("_c").alias("_in"))
    before = Window.partitionBy(*ids).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(*ids, "_slice", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    running = (Window.partitionBy(*ids, "_slice").orderBy("value")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sliced.join(offsets, [*ids, "_slice"], "inner").withColumn(
        "_upto", F.col("_before") + F.sum("_c").over(running))

    def value_at(rank):
        hit = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
        return F.max(F.when(hit, F.col("value")))

    found, out = [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n") - F.lit(1))
        found += [value_at(F.floor(place)).alias(f"_lo{i}"), value_at(F.ceil(place)).alias(f"_hi{i}")]
        out.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place - F.floor(place)))
    return (ranked.groupBy(*ids, "n").agg(*found)
            .select(*ids, F.col("n").cast("long").alias("n"), F.array(*out).alias("q")))


def wide_quantile(df: DataFrame, keys: Sequence[str], columns: Sequence[str], prob: float) -> DataFrame:
    """One quantile per key with a column per measure."""
    long = exact_quantiles(df, keys, columns, [prob])
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(c) for c in columns])
