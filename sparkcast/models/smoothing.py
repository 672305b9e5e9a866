"""Exponential smoothing: simple, trend, damped trend, additive or multiplicative season."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.models import scan
from sparkcast.models.gram import key_fields
from sparkcast.models.relay import RELAY_ROWS, relay
from sparkcast.session import cut_lineage
from sparkcast.operators.transform import backward, forward

# Fixed value: added to all values when a multiplicative season meets zeros.
ZERO_SHIFT = 0.01


@dataclass(frozen=True)
class SmoothingConfig:
    """One row of the smoothing grid; ``brute`` searches a finer grid of weights."""

    trend: str | None = None
    damped: bool = False
    seasonal: str | None = None
    season: int = 1
    remove_bias: bool = False
    brute: bool = False
    transf: str | None = None

    def weights(self) -> np.ndarray:
        """Candidate rows (alpha, beta, gamma, phi)."""
        fine = self.brute
        alphas = np.linspace(0.05, 0.95, 10) if fine else np.array([0.05, 0.1, 0.2, 0.4, 0.7])
        betas = (np.array([0.01, 0.05, 0.1, 0.3]) if fine else np.array([0.01, 0.1])) if self.trend else np.zeros(1)
        gammas = (np.array([0.01, 0.05, 0.1, 0.3]) if fine else np.array([0.05, 0.2])) if self.seasonal else np.zeros(1)
        phis = np.array([0.9, 0.98]) if self.trend and self.damped else np.ones(1)
        return np.array(list(product(alphas, betas, gammas, phis)))


# Weights are searched again around the best of a series, at half the distance, until that lowers the squared error by less.
TOLERANCE = 1e-3
FINEST = 12  # halvings at most, after which weights are known to 1e-4
LEAST, MOST = 1e-4, 1 - 1e-4


# A state holds candidates as rows: alpha, beta, gamma, phi, shift, bias, squared errors, sum of
# errors, count, level, trend, then the season by position.
HEAD = 11


def first_states(head: np.ndarray, cfg: SmoothingConfig, weights: np.ndarray) -> np.ndarray:
    """Start values from the first two seasons, missing values skipped."""
    m = max(cfg.season, 1)
    y = np.asarray(head, float)
    shift = ZERO_SHIFT if cfg.seasonal == "mul" and (y == 0).any() else 0.0
    y = y + shift
    one, two = y[:m], y[m:2 * m]
    seasonal = cfg.seasonal is not None
    known = y[np.isfinite(y)]
    level = np.nanmean(one) if seasonal and np.isfinite(one).any() else (known[0] if len(known) else 0.0)
    trend = 0.0
    if cfg.trend:
        if seasonal and np.isfinite(one).any() and np.isfinite(two).any():
            trend = (np.nanmean(two) - np.nanmean(one)) / m
        elif len(known) > 1:
            trend = known[1] - known[0]
    season = np.zeros(m)
    if cfg.seasonal == "add":
        season = np.nan_to_num(np.pad(one, (0, m - len(one)), constant_values=np.nan) - level)
    elif cfg.seasonal == "mul":
        ratio = np.pad(one, (0, m - len(one)), constant_values=np.nan) / (level if level else 1.0)
        season = np.where(np.isfinite(ratio) & (ratio > 0), ratio, 1.0)
    out = np.zeros((len(weights), HEAD + m))
    out[:, :4], out[:, 4], out[:, 9], out[:, 10], out[:, HEAD:] = weights, shift, level, trend, season
    return out


def walk(y: np.ndarray, t: np.ndarray, state: np.ndarray, seasonal: str | None, m: int) -> tuple[np.ndarray, np.ndarray]:
    """One-step forecasts of the first candidate, and the states after the rows."""
    s = state.copy()
    alpha, beta, gamma, phi = s[:, 0], s[:, 1], s[:, 2], s[:, 3]
    out = np.empty(len(y))
    for i in range(len(y)):
        slot = HEAD + int(t[i]) % m
        level, trend, season = s[:, 9].copy(), phi * s[:, 10], s[:, slot].copy()
        base = level + trend
        guess = base + season if seasonal == "add" else base * season if seasonal == "mul" else base
        out[i] = guess[0] + s[0, 5] - s[0, 4]
        if not np.isfinite(y[i]):
            s[:, 9], s[:, 10] = base, trend
            continue
        x = y[i] + s[:, 4]
        error = x - guess
        s[:, 6] += error * error
        s[:, 7] += error
        s[:, 8] += 1
        if seasonal == "add":
            plain = x - season
            s[:, slot] = gamma * (x - base) + (1 - gamma) * season
        elif seasonal == "mul":
            plain = x / np.where(np.abs(season) > 1e-9, season, 1e-9)
            s[:, slot] = gamma * x / np.where(np.abs(base) > 1e-9, base, 1e-9) + (1 - gamma) * season
        else:
            plain = x
        s[:, 9] = alpha * plain + (1 - alpha) * base
        s[:, 10] = beta * (s[:, 9] - level) + (1 - beta) * trend
    return out, s


def _states(heads: DataFrame, keys: Sequence[str], make) -> DataFrame:
    names = list(keys)
    schema = T.StructType([*key_fields(heads, keys), T.StructField("state", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[names].copy()
            out["state"] = [make(row) for _, row in pdf.iterrows()]
            yield out

    return heads.mapInPandas(run, schema)


def _around(best: np.ndarray, reach: float, cfg: SmoothingConfig) -> np.ndarray:
    """Candidates at ``reach`` (in log odds) on both sides of each weight that the model has; the best itself is the first."""
    free = [0] + [1] * bool(cfg.trend) + [2] * bool(cfg.seasonal) + [3] * bool(cfg.trend and cfg.damped)
    rows = [best]
    for column in free:
        inside = min(max(best[column], LEAST), MOST)
        for step in (-reach, reach):
            row = best.copy()
            row[column] = min(max(1 / (1 + (1 - inside) / inside * np.exp(-step)), LEAST), MOST)
            rows.append(row)
    return np.array(rows)


def _candidates(heads: DataFrame, keys: Sequence[str], make) -> DataFrame:
    """``(keys, cand, weights, state)`` of the weights ``make(row)`` for every row of ``heads``, from its first values ``head``."""
    names, doubles = list(keys), T.ArrayType(T.DoubleType())
    schema = T.StructType([*key_fields(heads, keys), T.StructField("cand", T.IntegerType()), T.StructField("weights", doubles),
                           T.StructField("state", doubles)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                weights, first = make(row)
                for i, (w, s) in enumerate(zip(weights, first)):
                    out.append((*row[names], i, w, [*s[9:], 1.0]))
            yield pd.DataFrame(out, columns=schema.names)

    return heads.mapInPandas(run, schema)


def _scanned(rows: DataFrame, keys: Sequence[str], heads: DataFrame, cfg: SmoothingConfig, weights: np.ndarray, given: bool,
             size: int) -> DataFrame:
    """``(keys, t, prediction)`` of an additive model, all chunks of a series side by side; see ``scan``."""
    names, m, seasonal = list(keys), max(cfg.season, 1), cfg.seasonal
    fields = key_fields(rows, keys)
    errors = T.StructType([*fields, T.StructField("cand", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("sse", "error", "n")]])

    def walked(part: pd.DataFrame, known: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        state = np.zeros((len(known), HEAD + m))
        state[:, :4] = np.stack(known["weights"].to_numpy())
        state[:, 9:] = np.stack(known["state"].to_numpy())[:, :-1]
        if "bias" in known:
            state[:, 5] = known["bias"]
        return walk(part["_y"].to_numpy(float), part["t"].to_numpy(), state, seasonal, m)

    def score(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        _, after = walked(part[part["split"] == "train"], known)
        out = known[[*names, "cand"]].copy()
        out["sse"], out["error"], out["n"] = after[:, 6], after[:, 7], after[:, 8]
        return out

    def judged(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """States by chunk, and of each key the best candidate with its errors."""
        starts = cut_lineage(starts)
        states = cut_lineage(scan.chunk_states(rows, keys, starts, seasonal == "add", m, size))
        found = scan.replay(rows.where("split = 'train'"), keys, states, score, errors, size)
        sums = found.groupBy(*names, "cand").agg(*[F.sum(c).alias(c) for c in ("sse", "error", "n")])
        sums = sums.withColumn("sse", F.when(F.isnan("sse") | F.col("sse").isNull(), float("inf")).otherwise(F.col("sse")))
        best = sums.groupBy(*names).agg(F.min(F.struct("sse", "cand", "error", "n")).alias("b")).select(*names, "b.*")
        return states, best.join(starts.select(*names, "cand", "weights"), [*names, "cand"])

    starts = _candidates(heads, keys, lambda row: (weights, first_states(row["head"], cfg, weights)))
    if len(weights) > 1 or cfg.remove_bias:
        states, best = judged(starts)
        best, reach = cut_lineage(best), 0.7
        while not given and reach > 0.7 / 2 ** FINEST:
            def nearer(row, reach=reach):
                tried = _around(np.asarray(row["weights"], float), reach, cfg)
                return tried, first_states(row["head"], cfg, tried)

            more, closer = judged(_candidates(heads.join(best.select(*names, "weights"), names), keys, nearer))
            closer = cut_lineage(closer)
            fall = closer.join(best.select(*names, F.col("sse").alias("was")), names).agg(F.max((F.col("was") - F.col("sse")) / F.col("was"))).first()[0]
            states, best, reach = more, closer, reach / 2
            if not (fall or 0) > TOLERANCE and reach < 0.1:
                break
        bias = F.col("error") / F.greatest("n", F.lit(1.0)) if cfg.remove_bias else F.lit(0.0)
        states = states.join(best.select(*names, "cand", bias.alias("bias")), [*names, "cand"], "left_semi") if not cfg.remove_bias else (
            states.join(best.select(*names, "cand", bias.alias("bias")), [*names, "cand"]))
    else:
        states = scan.chunk_states(rows, keys, cut_lineage(starts), seasonal == "add", m, size)

    def forecast(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = part[[*names, "t"]].copy()
        found, _ = walked(part, known)
        out["prediction"] = np.where(np.isfinite(found), found, np.nan)
        return out

    schema = T.StructType([*fields, T.StructField("t", T.LongType()), T.StructField("prediction", T.DoubleType())])
    done = scan.replay(rows, keys, states, forecast, schema, size)
    return done.withColumn("prediction", F.nanvl("prediction", F.lit(None).cast("double")))


def smoothing_forecast(df: DataFrame, keys: Sequence[str], y: str, cfg: SmoothingConfig,
                       weights: np.ndarray | None = None, one_step: bool = True,
                       size: int = RELAY_ROWS) -> DataFrame:
    """Add ``prediction`` to a split frame.

    Weights with the smallest squared one-step error on train are chosen per key. Unless they are given, additive models search
    again around the best of each key, nearer and nearer, until that lowers no error by more than ``TOLERANCE``. Test rows are
    forecast one step ahead, the state taking up each actual, or all from the end of train. Multiplicative seasons, whose steps
    aren't affine, hand their state on from stretch to stretch of ``size`` rows.
    """
    given = weights is not None
    weights = cfg.weights() if weights is None else np.atleast_2d(weights)
    m, width = max(cfg.season, 1), HEAD + max(cfg.season, 1)
    shown = forward(df, keys, y, cfg.transf)
    rows = shown.select(*keys, "t", "split", F.col(y).cast("double").alias("_y"))
    train = rows.filter(F.col("split") == "train")
    heads = (train.filter(F.col("t") < 2 * m).groupBy(*keys)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.coalesce("_y", F.lit(float("nan"))).alias("v")))),
                              lambda x: x["v"]).alias("head")))
    seasonal = cfg.seasonal
    if seasonal != "mul":
        masked = rows if one_step else rows.withColumn("_y", F.when(F.col("split") == "train", F.col("_y")))
        predictions = _scanned(masked, keys, heads, cfg, weights, given, size)
        out = backward(shown.join(predictions, [*keys, "t"], "left"), y, cfg.transf, ["prediction"])
        return out.select(*keys, "t", "prediction").join(df, [*keys, "t"])

    def learn(pdf: pd.DataFrame, state: np.ndarray):
        _, after = walk(pdf["_y"].to_numpy(float), pdf["t"].to_numpy(), state.reshape(-1, width), seasonal, m)
        return None, after.ravel()

    def forecast(pdf: pd.DataFrame, state: np.ndarray):
        values = pdf["_y"].to_numpy(float)
        if not one_step:
            values = np.where(pdf["split"].to_numpy() == "test", np.nan, values)
        out, after = walk(values, pdf["t"].to_numpy(), state.reshape(-1, width), seasonal, m)
        return out, after.ravel()

    start = _states(heads, keys, lambda r: first_states(r["head"], cfg, weights).ravel())
    if len(weights) > 1 or cfg.remove_bias:
        _, learned = relay(train, keys, start, learn, size)

        def choose(r) -> np.ndarray:
            s = np.asarray(r["state"], float).reshape(-1, width)
            best = s[np.nan_to_num(s[:, 6], nan=np.inf).argmin()]
            begin = first_states(r["head"], cfg, best[None, :4])
            if cfg.remove_bias:
                begin[:, 5] = best[7] / max(best[8], 1.0)
            return begin.ravel()

        start = _states(heads.join(learned, list(keys)), keys, choose)
    predictions, _ = relay(rows, keys, start, forecast, size)
    out = shown.join(predictions, [*keys, "t"], "left")
    out = backward(out, y, cfg.transf, ["prediction"])
    return out.select(*keys, "t", "prediction").join(df, [*keys, "t"])
