"""Imputation by the average of the nearest donor rows, exact and without comparing all pairs.

The distance is Euclidean over the columns both rows have, scaled up for the ones they lack. Rows with
the same known columns and donors with the same known columns form a pool with a fixed set of shared
columns. Inside a pool, donors are put into grid cells of 16 sizes. The smallest cell around a
receiver that holds k donors gives a radius its k nearest cannot exceed; the receiver then only meets
donors from the few cells that cover this radius. Equal donors are cut to the first k by time, since
no more of them can be chosen, and equal receivers are asked once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.operators.chunks import attach
from sparkcast.operators.impute import fill_values, train_rows
from sparkcast.session import cut_lineage

LEVELS = tuple(range(0, 32, 2))
GRID_DIMENSIONS = 3


def _mask(flags: Sequence[Column]) -> Column:
    total = F.lit(0).cast("long")
    for i, f in enumerate(flags):
        total = total + F.when(f, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def _has(mask: Column, i: Column) -> Column:
    return F.getbit(mask, i) == 1


def _shared(values: Column, mask: Column, width: int) -> Column:
    kept = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(_has(mask, i), F.get(values, i)))
    return F.filter(kept, lambda v: v.isNotNull())


def _place(i: int, radius: Column | None = None) -> Column:
    """Cell number of coordinate ``i`` shifted by a radius, at ``_level``; -1 where it does not exist."""
    x, last = F.get("_u", F.lit(i)), F.pow(F.lit(2.0), F.col("_level")) - 1.0
    if radius is not None:
        x = x + radius
    cell = F.floor((x - F.get("_low", F.lit(i))) / F.col("_width") * (last + 1.0)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(last, cell)), F.lit(-1.0)).cast("long")


def _square_distance(a: Column, b: Column, width: int) -> Column:
    """Written out per place, which compiles, unlike a fold over arrays."""
    total = F.lit(0.0)
    for i in range(width):
        gap = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        total = total + F.coalesce(gap * gap, F.lit(0.0))
    return total


def impute_knn(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = 10, time: str = "ds") -> DataFrame:
    """Fill gaps by the mean of the k nearest train rows of the key; the train mean if none is comparable."""
    columns, keys = list(columns), list(keys)
    width = len(columns)
    based = attach(df, fill_values(df, keys, columns, "mean"), keys)
    gappy = [F.col(f"_fill_{c}").isNotNull() for c in columns]
    based = based.withColumns({
        "_all": _mask(gappy),
        "_have": _mask([g & F.col(c).isNotNull() for g, c in zip(gappy, columns)]),
        "_vals": F.array(*[F.when(g, F.col(c).cast("double")) for g, c in zip(gappy, columns)]),
    }).withColumn("_vec", F.filter("_vals", lambda v: v.isNotNull()))
    based = cut_lineage(based)  # read by every branch below

    pool = [*keys, "_have", "_give"]
    receivers = (based.filter((F.col("_have") != F.col("_all")) & (F.col("_have") != 0))
                 .groupBy(*keys, "_have", "_vec").agg(
                     F.min(time).alias("_who"), F.min("_vals").alias("_vals"), F.min("_all").alias("_all")))
    receivers = cut_lineage(receivers)  # known by their first time from here on
    donors = (based.filter(train_rows(based) & (F.col("_have") != 0))
              .select(*keys, F.col("_have").alias("_give"), F.col("_vals").alias("_dvals"), F.col(time).alias("_dtime")))
    wanted = receivers.select(*keys, "_have").distinct()
    offered = donors.select(*keys, "_give").distinct()
    common = F.col("_have").bitwiseAND(F.col("_give"))
    useful = (common != 0) & (F.col("_give") != common)

    offers = (attach(donors, wanted, keys).filter(useful)
              .withColumn("_u", _shared(F.col("_dvals"), common, width)))
    same = Window.partitionBy(*pool, "_u").orderBy("_dtime")
    offers = offers.withColumn("_i", F.row_number().over(same)).filter(F.col("_i") <= k).drop("_i")
    offers = cut_lineage(offers)
    spans = offers.groupBy(*pool).agg(
        *[F.min(F.get("_u", F.lit(i))).alias(f"_lo{i}") for i in range(GRID_DIMENSIONS)],
        *[F.max(F.get("_u", F.lit(i))).alias(f"_hi{i}") for i in range(GRID_DIMENSIONS)])
    extent = F.greatest(*[F.coalesce(F.col(f"_hi{i}") - F.col(f"_lo{i}"), F.lit(0.0)) for i in range(GRID_DIMENSIONS)])
    spans = spans.select(
        *pool, F.filter(F.array(*[F.col(f"_lo{i}") for i in range(GRID_DIMENSIONS)]), lambda v: v.isNotNull()).alias("_low"),
        F.when(extent > 0, extent).otherwise(1.0).alias("_width"))

    levels = F.explode(F.array(*[F.lit(x) for x in LEVELS]))
    cells = [f"_c{i}" for i in range(GRID_DIMENSIONS)]
    places = {c: _place(i) for i, c in enumerate(cells)}
    spot = [*pool, "_level", *cells]
    placed = attach(offers, spans, pool).withColumn("_level", levels).withColumns(places).select(
        *spot, "_u", "_dvals", "_dtime")
    in_cell = Window.partitionBy(*spot).orderBy("_dtime")
    full = (placed.withColumn("_i", F.row_number().over(in_cell)).filter(F.col("_i") <= k)
            .groupBy(*spot).agg(F.collect_list("_u").alias("_near")).filter(F.size("_near") == k))

    who = [*pool, "_who"]
    asking = attach(
        attach(receivers, offered, keys).filter(useful).withColumn("_u", _shared(F.col("_vals"), common, width)),
        spans, pool).select(*who, "_u", "_all", "_low", "_width")
    asking = cut_lineage(asking)
    around = asking.withColumn("_level", levels).withColumns(places)
    tightest = (around.select(*who, "_level", *cells).join(full.select(*spot), spot)
                .groupBy(*who).agg(F.max(F.struct("_level", *cells)).alias("_s")).select(*who, "_s.*"))
    bounds = (tightest.join(full, spot).join(asking.select(*who, "_u"), who)
              .select(*who, F.sqrt(F.array_max(F.transform(
                  "_near", lambda d: _square_distance(F.col("_u"), d, width)))).alias("_radius")))
    sized = asking.join(bounds, who, "left").withColumn(
        "_radius", F.col("_radius") * F.lit(1.0 + 1e-9) + F.col("_width") * F.lit(1e-12))
    deepest = F.floor(F.log2(F.col("_width") / (F.col("_radius") * 2.0)) / 2.0) * 2
    level = F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[-1]), F.coalesce(deepest, F.lit(0)))).cast("int")
    reach = F.coalesce(F.col("_radius"), F.col("_width"))
    looking = sized.withColumn("_level", level)
    for i, c in enumerate(cells):  # a cube of that radius touches at most two cells per coordinate
        looking = looking.withColumn(c, F.explode(F.sequence(_place(i, -reach), _place(i, reach))))
    met = looking.join(placed.withColumnRenamed("_u", "_du"), spot)
    scale = F.bit_count("_all") / F.bit_count(common)
    met = met.withColumn("_d", _square_distance(F.col("_u"), F.col("_du"), width)).filter(
        F.col("_radius").isNull() | (F.col("_d") <= F.col("_radius") * F.col("_radius")))
    missing = F.filter(F.array(*[F.lit(i) for i in range(width)]),
                       lambda i: _has(F.col("_give"), i) & ~_has(F.col("_have"), i))
    one = [*keys, "_who"]
    gifts = met.select(*one, F.explode(missing).alias("_c"), (F.col("_d") * scale).alias("_d"), "_dtime", "_dvals")
    nearest = Window.partitionBy(*one, "_c").orderBy("_d", "_dtime")
    chosen = gifts.withColumn("_i", F.row_number().over(nearest)).filter(F.col("_i") <= k)
    values = chosen.groupBy(*one).agg(*[
        F.avg(F.when(F.col("_c") == i, F.get("_dvals", F.col("_c")))).alias(f"_knn_{c}") for i, c in enumerate(columns)])
    answers = receivers.select(*one, "_have", "_vec").join(values, one).drop("_who")
    out = based.join(answers, [*keys, "_have", "_vec"], "left")
    return out.select(*[
        F.when(F.col(f"_fill_{c}").isNull(), F.col(c).cast("double")).otherwise(
            F.coalesce(F.col(c).cast("double"), F.col(f"_knn_{c}"), F.col(f"_fill_{c}"))).alias(c)
        if c in columns else F.col(c) for c in df.columns])
