"""Additive smoothing of long series without walking them from end to end.

A step of an additive smoother is an affine map of its state (level, trend, season, 1). So are all steps of a chunk together: every chunk
but the last composes its map, whatever state it will start from. The maps of a series are then applied to its first state one
after the other, a matrix times a vector for each chunk, which gives the state that every chunk starts from; and all chunks walk their rows from
there side by side. The number of jobs doesn't depend on how long a series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.models.gram import key_fields
from sparkcast.operators.chunks import chunk_index
from sparkcast.session import cut_lineage

DOUBLES = T.ArrayType(T.DoubleType())


def chunk_map(y: np.ndarray, t: np.ndarray, weights: np.ndarray, seasonal: bool, m: int) -> np.ndarray:
    """For each row (alpha, beta, gamma, phi) of ``weights`` the matrix that takes (level, trend, season, 1) over the rows ``y``."""
    alpha, beta, gamma, phi = (w[:, None] for w in weights.T)
    maps = np.repeat(np.eye(m + 3)[None], len(weights), axis=0)
    for value, slot in zip(y, (np.asarray(t) % m).astype(int) + 2):
        level, trend, season = maps[:, 0].copy(), phi * maps[:, 1], maps[:, slot].copy()
        base = level + trend
        if not np.isfinite(value):
            maps[:, 0], maps[:, 1] = base, trend
            continue
        actual = np.zeros(m + 3)
        actual[-1] = value
        plain = actual - season if seasonal else actual
        maps[:, 0] = alpha * plain + (1 - alpha) * base
        maps[:, 1] = beta * (maps[:, 0] - level) + (1 - beta) * trend
        if seasonal:
            maps[:, slot] = gamma * (actual - base) + (1 - gamma) * season
    return maps


def _carry(names: list[str]):
    """The states between maps, from rows sorted by key, candidate, chunk and line of the map; a first state comes as chunk -1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, after = np.zeros(0), []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.chunk < 0:
                    state, after = np.asarray(row.line, float), []
                    out.append((*row[:len(names)], row.cand, 0, state))
                    continue
                after.append(float(np.asarray(row.line) @ state))
                if len(after) == len(state):
                    state, after = np.array(after), []
                    out.append((*row[:len(names)], row.cand, row.chunk + 1, state))
            if out:
                yield pd.DataFrame(out, columns=[*names, "cand", "chunk", "state"])

    return run


def chunk_states(rows: DataFrame, keys: Sequence[str], starts: DataFrame, seasonal: bool, m: int, size: int) -> DataFrame:
    """``(keys, cand, chunk, weights, state)``: what every chunk of ``size`` rows starts from.

    ``rows`` has the keys, ``t``, counted from 0 without gaps, and ``_y``. ``starts`` has a row ``(keys, cand, weights, state)`` for every
    candidate of a key, with the state (level, trend, season, 1) before its first row.
    """
    names = list(keys)
    chunked = rows.select(*names, "t", "_y", chunk_index("t", size).alias("chunk"))
    last = chunked.groupBy(*names).agg(F.max("chunk").alias("last"))
    given = starts.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("cand", "weights"))).alias("given"))
    # the candidates go to every chunk that another one follows; a series of one chunk has none
    wanted = cut_lineage(last.where("last > 0").join(given, names).select(
        *names, "given", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)).alias("chunk")))
    by = [*names, "chunk"]
    fields = [*key_fields(rows, keys), T.StructField("cand", T.IntegerType()), T.StructField("chunk", T.LongType())]

    def maps(part: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        columns = [*names, "cand", "chunk", "i", "line"]
        if not len(part) or not len(ask):
            return pd.DataFrame(columns=columns)
        part = part.sort_values("t")
        cands = ask["given"].iloc[0]
        weights = np.array([np.asarray(c["weights"], float) for c in cands])
        found = chunk_map(part["_y"].to_numpy(float), part["t"].to_numpy(), weights, seasonal, m)
        key = tuple(ask[names].iloc[0])
        return pd.DataFrame([(*key, c["cand"], ask["chunk"].iloc[0], i, line) for c, one in zip(cands, found) for i, line in enumerate(one)],
                            columns=columns)

    schema = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("line", DOUBLES)])
    lines = chunked.join(wanted.select(*by), by, "left_semi").groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(maps, schema)
    first = starts.select(*names, "cand", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("i"), F.col("state").alias("line"))
    ordered = lines.unionByName(first).repartition(*names, "cand").sortWithinPartitions(*names, "cand", "chunk", "i")
    carried = ordered.mapInPandas(_carry(names), T.StructType([*fields, T.StructField("state", DOUBLES)]))
    return carried.join(starts.select(*names, "cand", "weights"), [*names, "cand"])


def replay(rows: DataFrame, keys: Sequence[str], states: DataFrame, step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
           schema: T.StructType, size: int) -> DataFrame:
    """``step(rows of a chunk by t, its states by candidate)`` for all chunks."""
    by = [*keys, "chunk"]

    def run(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(known):
            return pd.DataFrame(columns=schema.names)
        return step(part.sort_values("t"), known.sort_values("cand"))

    chunked = rows.withColumn("chunk", chunk_index("t", size))
    return cut_lineage(chunked.groupBy(*by).cogroup(states.groupBy(*by)).applyInPandas(run, schema))
