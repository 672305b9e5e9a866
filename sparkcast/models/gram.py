"""Moments of columns: all that least squares needs to know about the rows.

With columns ``x1..xd, y`` these are the number of rows, the means, and the sums of products of deviations from the means. They are
gathered as such, by partial aggregates that merge means and products of deviations (Chan's rule): sums of raw products would lose
everything where values are large against their spread. A key of any size costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.operators.chunks import CHUNK_ROWS, chunk_index

# Beyond this many moments the generated aggregate code gets too large; Arrow batches take over.
MAX_JVM_SUMS = 45
LOTS = 16


def pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def complete(columns: Sequence[str]) -> Column:
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return keep


def _moments(columns: Sequence[str], known: Column | None = None, over=None) -> tuple[Column, list[Column], list[Column]]:
    """Count, means and products of deviations, by rows of pairs, of the rows that are ``known``; over a window if one is given."""
    z = [F.col(c).cast("double") if known is None else F.when(known, F.col(c).cast("double")) for c in columns]
    wrap = (lambda c: c) if over is None else (lambda c: c.over(over))
    n = wrap(F.count(z[0])).cast("double")
    means = [wrap(F.avg(x)) for x in z]
    return n, means, [wrap(F.covar_pop(z[i], z[j])) * n for i, j in pairs(len(z))]


def _packed(n: Column, means: Sequence[Column], products: Sequence[Column]) -> Column:
    return F.array(n, *[F.coalesce(x, F.lit(0.0)) for x in [*means, *products]])


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key ``m``, the moments of the rows without a NULL or NaN, as the upper triangle of (count, means; products of deviations)."""
    rows = df.filter(complete(columns))
    if len(pairs(len(columns) + 1)) <= MAX_JVM_SUMS:
        return rows.groupBy(*keys).agg(_packed(*_moments(columns)).alias("m"))
    names = list(keys)
    schema = T.StructType([*key_fields(df, keys), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*key, of_rows(group[list(columns)].to_numpy(float))) for key, group in pdf.groupby(names, sort=False, dropna=False)]
            if out:
                yield pd.DataFrame(out, columns=[*names, "m"])

    parts = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(partial, schema)
    return merged(parts, keys)


def of_rows(x: np.ndarray) -> np.ndarray:
    """The packed moments of rows that are all known."""
    width = x.shape[1] + 1
    out = np.zeros((width, width))
    mean = x.mean(axis=0) if len(x) else np.zeros(width - 1)
    out[0, 0], out[0, 1:], out[1:, 1:] = len(x), mean, (x - mean).T @ (x - mean)
    return out[np.triu_indices(width)]


def merge(packed: np.ndarray) -> np.ndarray:
    """Packed moments of all rows from those of parts, one a row."""
    width = int((np.sqrt(8 * packed.shape[1] + 1) - 1) / 2)
    n = packed[:, 0]
    total = n.sum()
    mean = n @ packed[:, 1:width] / max(total, 1.0)
    apart = packed[:, 1:width] - mean
    i, j = np.triu_indices(width - 1)
    return np.concatenate([[total], mean, packed[:, width:].sum(axis=0) + n @ (apart[:, i] * apart[:, j])])


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key ``m`` from rows ``(keys, m)`` of parts; a key with very many is merged lot by lot first."""
    names = list(keys)
    schema = T.StructType([*key_fields(parts, keys), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = merge(np.stack([np.asarray(m, float) for m in pdf["m"]]))
        return pd.DataFrame([(*pdf[names].iloc[0], whole)], columns=[*names, "m"])

    lots = parts.withColumn("_lot", F.pmod(F.xxhash64("m"), F.lit(LOTS)))
    return lots.groupBy(*names, "_lot").applyInPandas(lambda pdf: run(pdf), schema).groupBy(*names).applyInPandas(run, schema)


def _before(totals: DataFrame, keys: Sequence[str], width: int) -> tuple[Column, list[Column], list[Column]]:
    """Moments of all earlier chunks from rows ``(keys, _chunk, n, means, products)``, by sums about the mean of the first chunk."""
    by_key = Window.partitionBy(*keys).orderBy("_chunk")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("_n").over(earlier), F.lit(0.0))
    pivots = [F.first(F.when(F.col("_n") > 0, F.col(f"_m{i}")), ignorenulls=True).over(whole) for i in range(width)]
    named = totals.withColumns({f"_p{i}": p for i, p in enumerate(pivots)})
    apart = [F.col(f"_m{i}") - F.col(f"_p{i}") for i in range(width)]
    sums = {f"_d{i}": F.coalesce(F.sum(F.col("_n") * a).over(earlier), F.lit(0.0)) for i, a in enumerate(apart)}
    sums |= {f"_q{k}": F.coalesce(F.sum(F.col(f"_s{k}") + F.col("_n") * apart[i] * apart[j]).over(earlier), F.lit(0.0))
             for k, (i, j) in enumerate(pairs(width))}
    named = named.withColumns({"_n0": n, **sums})
    some = F.greatest(F.col("_n0"), F.lit(1.0))
    means = {f"_m0{i}": F.coalesce(F.col(f"_p{i}") + F.col(f"_d{i}") / some, F.lit(0.0)) for i in range(width)}
    products = {f"_s0{k}": F.col(f"_q{k}") - F.col(f"_d{i}") * F.col(f"_d{j}") / some for k, (i, j) in enumerate(pairs(width))}
    return named.select(*keys, "_chunk", "_n0", *[c.alias(x) for x, c in {**means, **products}.items()])


def running_gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pos: str = "t") -> DataFrame:
    """Add to every row ``m``, the moments of all earlier rows of its key."""
    known, width = complete(columns), len(columns)
    marked = df.withColumn("_chunk", chunk_index(pos, CHUNK_ROWS))
    n, means, products = _moments(columns, known)
    totals = marked.groupBy(*keys, "_chunk").agg(
        n.alias("_n"), *[F.coalesce(x, F.lit(0.0)).alias(f"_m{i}") for i, x in enumerate(means)],
        *[F.coalesce(x, F.lit(0.0)).alias(f"_s{k}") for k, x in enumerate(products)])
    carried = _before(totals, keys, width)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    n, means, products = _moments(columns, known, inside)
    here = marked.join(carried, [*keys, "_chunk"]).withColumns({
        "_n1": n, **{f"_m1{i}": F.coalesce(x, F.lit(0.0)) for i, x in enumerate(means)},
        **{f"_s1{k}": F.coalesce(x, F.lit(0.0)) for k, x in enumerate(products)}})
    n = F.col("_n0") + F.col("_n1")
    share = F.col("_n1") / F.greatest(n, F.lit(1.0))
    apart = [F.col(f"_m1{i}") - F.col(f"_m0{i}") for i in range(width)]
    m = F.array(n, *[F.col(f"_m0{i}") + apart[i] * share for i in range(width)],
                *[F.col(f"_s0{k}") + F.col(f"_s1{k}") + apart[i] * apart[j] * F.col("_n0") * share for k, (i, j) in enumerate(pairs(width))])
    return here.select(*df.columns, m.alias("m"))


def carried_gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key and ``_chunk`` the moments ``m`` of all earlier chunks, for many columns.

    A line of the matrix is carried on its own, so no task gathers the moments of a whole key.
    """
    width = len(columns)
    names = list(keys)
    every = df.select(*names, "_chunk").distinct()
    by_chunk = every.join(gram(df, [*names, "_chunk"], columns), [*names, "_chunk"], "left")
    by_key = Window.partitionBy(*names).orderBy("_chunk")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.slice("m", 2, width)
    about = by_chunk.withColumn("_p", F.first(F.when(F.get("m", F.lit(0)) > 0, mean), ignorenulls=True).over(whole))
    about = about.withColumns({"_n": F.coalesce(F.get("m", F.lit(0)), F.lit(0.0)), "_a": F.coalesce(
        F.zip_with(mean, "_p", lambda x, p: x - p), F.array_repeat(F.lit(0.0), width))})
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(pairs(width + 1))])
    cell = about.select(*names, "_chunk", "_p", "_n", "_a", "m", F.inline(cells))
    ai, aj = (F.coalesce(F.get("_a", F.col(c) - 1), F.lit(1.0)) for c in ("i", "j"))
    own = F.when(F.col("i") > 0, F.coalesce(F.get("m", F.col("k")), F.lit(0.0))).otherwise(0.0)
    earlier = Window.partitionBy(*names, "k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    sums = cell.select(*names, "_chunk", "k", "i", "j", "_p", total(F.col("_n")).alias("n"), total(F.col("_n") * ai).alias("di"),
                       total(F.col("_n") * aj).alias("dj"), total(own + F.col("_n") * ai * aj).alias("q"))
    some = F.greatest("n", F.lit(1.0))
    value = (F.when(F.col("k") == 0, F.col("n")).when(F.col("i") == 0, F.coalesce(F.get("_p", F.col("j") - 1), F.lit(0.0)) + F.col("dj") / some)
             .otherwise(F.col("q") - F.col("di") * F.col("dj") / some))
    return sums.select(*names, "_chunk", "k", value.alias("v")).groupBy(*names, "_chunk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("m"))


def unpack(m: Sequence[np.ndarray], width: int) -> np.ndarray:
    """Upper triangles to symmetric matrices, stacked along the first axis."""
    flat = np.array([np.asarray(r, float) for r in m]).reshape(len(m), -1)
    out = np.zeros((len(m), width, width))
    i, j = np.triu_indices(width)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def added(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The moments ``g`` (a matrix) followed by those after each of the known ``rows``; NaN in a row keeps it out. Also the last ones."""
    n, mean, products = g[0, 0], g[0, 1:], g[1:, 1:]
    known = np.isfinite(rows).all(axis=1)
    about = mean if n else (rows[known][0] if known.any() else mean)
    off = np.where(known[:, None], rows - about, 0.0)
    shift = n * (mean - about)
    count = n + np.cumsum(known)
    sums = shift + np.cumsum(off, axis=0)
    squares = products + np.outer(shift, shift) / max(n, 1.0) + np.cumsum(off[:, :, None] * off[:, None, :], axis=0)
    after = np.zeros((len(rows), *g.shape))
    some = np.maximum(count, 1.0)[:, None]
    after[:, 0, 0], after[:, 0, 1:], after[:, 1:, 0] = count, about + sums / some, about + sums / some
    after[:, 1:, 1:] = squares - sums[:, :, None] * sums[:, None, :] / some[:, :, None]
    return np.concatenate([g[None], after[:-1]]), after[-1]


def centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``n, mean x, mean y, Sxx, Sxy, Syy`` of stacked moments, the last column being y."""
    mean, s = g[:, 0, 1:], g[:, 1:, 1:]
    return g[:, 0, 0], mean[:, :-1], mean[:, -1], s[:, :-1, :-1], s[:, :-1, -1], s[:, -1, -1]
