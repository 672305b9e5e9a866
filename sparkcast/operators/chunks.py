"""Ordered work on long series without putting a series into one task.

Every window in this package is partitioned by ``keys + chunk``, where a chunk is a fixed number of
consecutive positions. Rows near a chunk border are copied into the neighbouring chunk (the halo), so
a frame of bounded reach sees all its rows; the copies are dropped afterwards. Unbounded frames are
split into a running part inside the chunk and the totals of all earlier chunks.

A position is a dense integer: the calendar tick of a regular series, or ``with_ordinal`` else.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 1024
SPREAD = 16


def tick(time: str | Column, freq: str = "D") -> Column:
    """Whole steps since the epoch: days, weeks that end on Sunday, or hours."""
    col = F.col(time) if isinstance(time, str) else time
    if freq == "D":
        return F.unix_date(col).cast("long")
    if freq == "W":
        return F.floor((F.unix_date(col) - F.lit(3)) / F.lit(7)).cast("long")
    if freq == "H":
        return F.floor(F.unix_seconds(col) / F.lit(3600)).cast("long")
    raise ValueError(f"unknown frequency {freq!r}")


def chunk_index(pos: str | Column, size: int) -> Column:
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(col / F.lit(size)).cast("long")


def windowed(df: DataFrame, keys: Sequence[str], pos: str | Column,
             build: Callable[..., Mapping[str, Column]], back: int = 0, ahead: int = 0,
             size: int | None = None) -> DataFrame:
    """Add columns computed over windows that reach ``back`` rows behind and ``ahead`` rows on.

    ``build(make)`` returns the new columns; ``make(*by)`` gives the ordered window of a chunk,
    further split by the columns ``by``. All of them share one shuffle.
    """
    size = size or max(CHUNK_ROWS, 4 * (back + ahead))
    place = pos if isinstance(pos, Column) else F.col(pos)
    tagged = df.withColumn("_pos", place.cast("long"))
    tagged = tagged.withColumn("_own", chunk_index("_pos", size))
    first = chunk_index(F.col("_pos") - F.lit(ahead), size)
    last = chunk_index(F.col("_pos") + F.lit(back), size)
    copies = tagged.withColumn("_chunk", F.explode(F.sequence(first, last)))
    copies = copies.repartition(*keys, "_chunk")

    def make(*by: str | Column) -> WindowSpec:
        return Window.partitionBy(*keys, "_chunk", *by).orderBy("_pos")

    new = build(make)
    return (copies.select("*", *[c.alias(name) for name, c in new.items()])
            .filter(F.col("_own") == F.col("_chunk")).drop("_pos", "_own", "_chunk"))


def with_ordinal(df: DataFrame, keys: Sequence[str], time: str = "ds", name: str = "t",
                 total: str | None = "n_rows", freq: str = "D", size: int = CHUNK_ROWS) -> DataFrame:
    """Zero-based row number by time within the key, and the number of rows of the key.

    Rows are numbered inside stretches of time; the stretch totals, which are few, give the offset.
    """
    marked = df.withColumn("_chunk", chunk_index(tick(time, freq), size))
    counts = marked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_chunk",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(by_key).alias("_total"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(time)
    out = marked.join(offsets, [*keys, "_chunk"], "inner").withColumn(
        name, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_chunk", "_offset", "_total", "_rows")


def running_sums(df: DataFrame, keys: Sequence[str], pos: str | Column, sums: Mapping[str, Column],
                 whole: Mapping[str, Column] | None = None, size: int = CHUNK_ROWS) -> DataFrame:
    """Add, for every row, sums over all earlier rows of its key (0 for the first row).

    ``whole`` adds sums over all rows of the key, from the same chunk totals.
    """
    whole = whole or {}
    place = pos if isinstance(pos, Column) else F.col(pos)
    marked = df.withColumn("_pos", place.cast("long")).withColumn("_chunk", chunk_index("_pos", size))
    totals = marked.groupBy(*keys, "_chunk").agg(
        *[F.sum(e).alias(f"_sum_{n}") for n, e in {**sums, **whole}.items()])
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0.0)).alias(f"_carry_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(by_key).alias(n) for n in whole])
    inside = (Window.partitionBy(*keys, "_chunk").orderBy("_pos")
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = marked.join(carried, [*keys, "_chunk"], "inner")
    out = joined.select("*", *[
        (F.coalesce(F.sum(e).over(inside), F.lit(0.0)) + F.col(f"_carry_{n}")).alias(n)
        for n, e in sums.items()])
    return out.drop("_pos", "_chunk", *[f"_carry_{n}" for n in sums])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], spread: int = SPREAD) -> DataFrame:
    """Put the statistics of a key next to all of its rows (a left join).

    Unless the optimizer finds the statistics small enough to broadcast, both sides are shuffled by
    key and a number drawn from the row itself, so that a key with very many rows is not sent to one
    task, neither by the join nor by an aggregation that would reuse its partitioning.
    """
    content = [c for c in df.columns if c not in keys]
    lot = F.pmod(F.xxhash64(*content), F.lit(spread)) if content else F.lit(0).cast("long")
    copies = stats.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return df.withColumn("_lot", lot).join(copies, [*keys, "_lot"], "left").drop("_lot")
