"""Chained imputation: each column with gaps is regressed on the others, round after round.

Rows without gaps never change, so their moments are gathered once. The rows with gaps are dealt into blocks. A round is one job over
them: from the moments of the round before, one matrix for each column, come the regressions of all columns; a block sweeps its rows, column by column, each with
the values that the ones before have just got, and hands on its moments for the next round.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.models.gram import gram, key_fields, merge, of_rows, unpack
from sparkcast.models.linear import LinearConfig, solve_each
from sparkcast.operators.chunks import attach
from sparkcast.operators.impute import fill_values, train_rows
from sparkcast.session import cut_lineage

BLOCK_ROWS = 16384
DOUBLES = T.ArrayType(T.DoubleType())


def _normals(rows: np.ndarray, *parts: int) -> np.ndarray:
    """Standard normal draws that depend on the hash of each row and on ``parts``, nothing else (Box-Muller)."""
    def unit(salt: int) -> np.ndarray:
        x = rows.view(np.uint64)
        for part in (*parts, salt):
            x = (x ^ np.uint64(part & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            x = x ^ x >> np.uint64(31)
        return ((x >> np.uint64(12)).astype(float) + 1) / ((1 << 52) + 1)

    return np.sqrt(-2 * np.log(unit(1))) * np.cos(2 * np.pi * unit(2))


def _block_moments(x: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """For each column the packed moments of all columns over the rows that have a value in it; rows are put together by their gaps."""
    patterns, of = np.unique(gaps, axis=0, return_inverse=True)
    parts = np.stack([of_rows(x[of == i]) for i in range(len(patterns))]) if len(patterns) else np.zeros((0, 0))
    d = x.shape[1]
    return np.stack([merge(parts[~patterns[:, c]]) if len(patterns) and (~patterns[:, c]).any() else of_rows(x[:0]) for c in range(d)])


def impute_iterative(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rounds: int = 100, tolerance: float = 1e-3,
                     sample: bool = False, min_value: float | None = 0.0, max_value: float | None = None, seed: int = 0,
                     time: str = "ds", model: LinearConfig | None = None) -> DataFrame:
    """Chained imputation learned from train rows, by Bayesian ridge unless another ``model`` is given; filled values are kept in bounds.

    Ends when no filled value moves by more than ``tolerance`` of its column's standard deviation (of the values there are), or after
    ``rounds``. ``sample`` draws coefficients (by the Cholesky factor of their covariance) and noise instead of taking the mean, in
    every one of ``rounds``; a draw depends on the key, row, column, round and seed only, so a repeated task draws alike.
    """
    columns, keys = list(columns), list(keys)
    if len(columns) < 2:
        from sparkcast.operators.impute import impute_simple
        return impute_simple(df, keys, columns, "mean")
    cfg = model or LinearConfig("bayesridge")
    d = len(columns)
    size = (d + 1) * (d + 2) // 2
    based = attach(df, fill_values(df, keys, columns, "mean"), keys)
    based = based.withColumn("_train", train_rows(based))
    based = based.withColumn("_gaps", F.array(*[F.col(c).isNull() & F.col(f"_fill_{c}").isNotNull() for c in columns]))
    based = based.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")) for c in columns})
    any_gap = F.exists("_gaps", lambda g: g)
    settled = based.filter(~any_gap)
    fixed = cut_lineage(gram(settled.filter("_train"), keys, columns))
    holes = based.filter(any_gap)
    counts = holes.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    holes = attach(holes, counts, keys).withColumn("_row", F.xxhash64(*keys, time)).withColumn("_block", F.pmod("_row", "_blocks"))
    passed = [c for c in df.columns if c not in columns]
    state = holes.select(*passed, "_block", "_row", "_train", "_gaps", *columns)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in state.schema.fields], T.StructField("_part", DOUBLES),
                           T.StructField("_moved", T.DoubleType())])
    by = [*keys, "_block"]

    def sweep(number: int):
        def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame(columns=schema.names)
            x, gaps, moved = rows[columns].to_numpy(float), np.stack(rows["_gaps"].to_numpy()).astype(bool), 0.0
            at = rows["_row"].to_numpy()
            key = zlib.crc32(repr(tuple(rows[keys].iloc[0])).encode())
            for c in range(d) if len(known) else ():
                w, mid, root, (mean, noise, spread) = (np.asarray(v, float) for v in known["_models"].iloc[0][c])
                mine = gaps[:, c]
                if sample:
                    w = w + root.reshape(d - 1, d - 1) @ np.random.default_rng([key, c, number, seed]).standard_normal(d - 1)
                found = mean + (np.delete(x[mine], c, axis=1) - mid) @ w
                if sample:
                    found = found + np.sqrt(noise) * _normals(at[mine], c, number, seed)
                found = np.clip(found, -np.inf if min_value is None else min_value, np.inf if max_value is None else max_value)
                good = np.isfinite(found)
                if good.any():
                    moved = max(moved, (np.abs(found - x[mine, c])[good] / max(spread, 1e-300)).max())
                x[mine, c] = np.where(good, found, x[mine, c])
            out = rows.copy()
            out[columns] = x
            out["_part"], out["_moved"] = None, np.nan
            learn = rows["_train"].to_numpy(bool) & np.isfinite(x).all(axis=1)
            part = {**dict.fromkeys(schema.names), **dict(zip(by, rows[by].iloc[0])),
                    "_part": _block_moments(x[learn], gaps[learn]).ravel(), "_moved": moved}
            return pd.concat([out[schema.names].astype(object), pd.DataFrame([part], dtype=object)], ignore_index=True)

        return run

    models = T.StructType([*key_fields(df, keys), T.StructField("_models", T.ArrayType(T.ArrayType(DOUBLES)))])

    def solved(parts: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        if not len(parts):
            return pd.DataFrame(columns=models.names)
        packed = np.stack([np.asarray(m, float) for m in parts["_part"]]).reshape(len(parts), d, size)
        rest = [np.asarray(m, float) for m in whole["m"]]
        g = unpack([merge(np.stack([*packed[:, c], *rest])) for c in range(d)], d + 1)
        orders = [[0, *[i + 1 for i in range(d) if i != c], c + 1] for c in range(d)]
        (w, _, mid, cov, noise), _ = solve_each(np.stack([m[np.ix_(o, o)] for m, o in zip(g, orders)]), cfg)
        found = []
        for c in range(d):
            values, vectors = np.linalg.eigh(np.nan_to_num(cov[c]))
            root = vectors * np.sqrt(np.maximum(values, 0))
            if values.min() > 0:
                root = np.linalg.cholesky(cov[c])
            spread = np.sqrt(g[c, c + 1, c + 1] / max(g[c, 0, 0], 1.0))
            found.append([w[c], mid[c], root.ravel(), [g[c, 0, c + 1], np.nan_to_num(noise[c]), spread]])
        return pd.DataFrame([(*parts[keys].iloc[0], found)], columns=models.names)

    def merged_lots(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = np.stack([np.asarray(m, float) for m in pdf["_part"]]).reshape(len(pdf), d, size)
        return pd.DataFrame([(*pdf[keys].iloc[0], np.concatenate([merge(packed[:, c]) for c in range(d)]))], columns=[*keys, "_part"])

    lots = T.StructType([*key_fields(df, keys), T.StructField("_part", DOUBLES)])
    blank = df.sparkSession.createDataFrame([], T.StructType([*key_fields(df, keys), T.StructField("_block", T.LongType()), models["_models"]]))
    asked = blank
    for number in range(rounds + 1):
        swept = cut_lineage(state.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(sweep(number), schema))
        state = swept.where("_part IS NULL").drop("_part", "_moved")
        parts = swept.where("_part IS NOT NULL").select(*keys, "_block", "_part", "_moved")
        if number == rounds or (number and not sample and (parts.agg(F.max("_moved")).first()[0] or 0.0) <= tolerance):
            break
        some = parts.groupBy(*keys, F.pmod("_block", F.lit(16))).applyInPandas(lambda pdf: merged_lots(pdf), lots)
        found = some.groupBy(*keys).cogroup(fixed.groupBy(*keys)).applyInPandas(solved, models)
        asked = cut_lineage(parts.select(*keys, "_block").join(found, keys))
    return settled.select(*df.columns).unionByName(state.select(*df.columns))
