"""Linear forecasts: ridge, lasso, elastic net, Bayesian ridge, automatic relevance determination.

One fit per key and configuration from moments; a one-step-ahead forecast refits on all earlier
rows by running moments instead of by repeated training.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.models.gram import (MAX_JVM_SUMS, added, carried_gram, centred, complete, gram, key_fields, pairs,
                                   running_gram, unpack)
from sparkcast.operators.chunks import CHUNK_ROWS, attach, chunk_index
from sparkcast.session import cut_lineage

# Rows of a chunk solved together when there are many features.
WIDE_BATCH = 128


@dataclass(frozen=True)
class LinearConfig:
    """One row of a hyper-parameter grid for a linear model."""

    method: str = "ridge"
    alpha: float = 1.0
    l1_ratio: float = 0.5
    normalize: bool = False
    alpha_1: float = 1e-6
    alpha_2: float = 1e-6
    lambda_1: float = 1e-6
    lambda_2: float = 1e-6
    threshold_lambda: float = 1e4
    cfg_id: int = 0


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a + 1e-12 * np.eye(a.shape[-1]), b[..., None])[..., 0]


def _check_independent(sxx: np.ndarray) -> None:
    """Without a penalty, features that depend on each other have no one solution."""
    size = np.sqrt(np.maximum(np.diagonal(sxx, axis1=1, axis2=2), 0.0))
    scale = np.where(size > 0, size, 1.0)
    if (np.linalg.eigvalsh(sxx / (scale[:, :, None] * scale[:, None, :]))[:, 0] < 1e-10).any():
        raise np.linalg.LinAlgError("features depend on each other")


def _descent(sxx: np.ndarray, sxy: np.ndarray, n: np.ndarray, l1: float, l2: float, tol: float = 1e-8,
             rounds: int = 2000) -> np.ndarray:
    """Cyclic coordinate descent for all keys of a batch at once."""
    w = np.zeros_like(sxy)
    scale = np.diagonal(sxx, axis1=1, axis2=2) / n[:, None] + l2
    for _ in range(rounds):
        moved = np.zeros(len(w))
        for j in range(w.shape[1]):
            rho = (sxy[:, j] - np.einsum("ni,ni->n", sxx[:, j], w) + sxx[:, j, j] * w[:, j]) / n
            new = np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) / np.where(scale[:, j] > 0, scale[:, j], 1.0)
            moved = np.maximum(moved, np.abs(new - w[:, j]))
            w[:, j] = new
        if (moved <= tol * np.maximum(np.abs(w).max(axis=1), 1e-12)).all():
            break
    return w


def evidence(sxx: np.ndarray, sxy: np.ndarray, syy: float, n: float, cfg: LinearConfig, single: bool,
              rounds: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Evidence maximisation (MacKay): one weight precision, or one per feature with pruning."""
    d = len(sxy)
    noise = 1.0 / max(syy / n, 1e-12)
    precision = np.ones(d)
    keep = np.ones(d, bool)
    w, cov = np.zeros(d), np.zeros((d, d))
    for _ in range(rounds):
        old = w
        w, cov = np.zeros(d), np.zeros((d, d))
        idx = np.flatnonzero(keep)
        if len(idx):
            block = np.linalg.inv(np.diag(precision[idx]) + noise * sxx[np.ix_(idx, idx)])
            cov[np.ix_(idx, idx)] = block
            w[idx] = noise * block @ sxy[idx]
        gamma = np.where(keep, 1.0 - precision * np.diag(cov), 0.0)
        rss = max(syy - 2 * w @ sxy + w @ sxx @ w, 0.0)
        if single:
            precision = np.full(d, (gamma.sum() + 2 * cfg.lambda_1) / (w @ w + 2 * cfg.lambda_2))
        else:
            precision = np.where(keep, (gamma + 2 * cfg.lambda_1) / (w ** 2 + 2 * cfg.lambda_2), precision)
            keep = keep & (precision < cfg.threshold_lambda)
        noise = (n - gamma.sum() + 2 * cfg.alpha_1) / (rss + 2 * cfg.alpha_2)
        if np.abs(w - old).sum() < tol * max(np.abs(w).sum(), 1e-300):
            break
    w = np.where(keep, w, 0.0)
    return w, cov, 1.0 / noise


def solve(g: np.ndarray, cfg: LinearConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``coef, intercept, mean x, coefficient covariance, noise variance`` for stacked moments."""
    n, mx, my, sxx, sxy, syy = centred(g)
    norm = np.ones_like(sxy)
    if cfg.normalize:
        norm = np.sqrt(np.maximum(np.diagonal(sxx, axis1=1, axis2=2), 0.0))
        norm = np.where(norm > 0, norm, 1.0)
        sxx, sxy = sxx / (norm[:, :, None] * norm[:, None, :]), sxy / norm
    d = sxy.shape[1]
    cov, noise = np.zeros_like(sxx), np.full(len(n), np.nan)
    if cfg.method == "ridge":
        if cfg.alpha == 0 and d:
            _check_independent(sxx)
        w = _solve(sxx + cfg.alpha * np.eye(d), sxy)
    elif cfg.method == "ols":
        w = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(sxx, sxy)])
    elif cfg.method in ("lasso", "elasticnet"):
        share = 1.0 if cfg.method == "lasso" else cfg.l1_ratio
        w = _descent(sxx, sxy, np.maximum(n, 1.0), cfg.alpha * share, cfg.alpha * (1.0 - share))
    elif cfg.method in ("bayesridge", "ard"):
        fits = [evidence(a, b, c, max(k, 1.0), cfg, cfg.method == "bayesridge")
                for a, b, c, k in zip(sxx, sxy, syy, n)]
        w = np.stack([f[0] for f in fits])
        cov = np.stack([f[1] for f in fits]) / (norm[:, :, None] * norm[:, None, :])
        noise = np.array([f[2] for f in fits])
    else:
        raise ValueError(f"unknown linear method {cfg.method!r}")
    w = w / norm
    if cfg.method == "ols":
        rss = syy - np.einsum("ni,ni->n", w, sxy)
        noise = np.maximum(rss, 0.0) / np.maximum(n - d - 1, 1.0)
    return w, my - np.einsum("ni,ni->n", w, mx), mx, cov, noise


def solve_each(g: np.ndarray, cfg: LinearConfig) -> tuple[tuple[np.ndarray, ...], list[str]]:
    """``solve`` with a status per row: what cannot be solved is empty and says why, whatever it is stacked with."""
    try:
        found = solve(g, cfg)
        if all(np.isfinite(part).all() for part in found[:2]):
            return found, ["ok"] * len(g)
    except (ValueError, np.linalg.LinAlgError):
        pass
    rows, status = [], []
    d = g.shape[1] - 2
    empty = (np.full((1, d), np.nan), np.full(1, np.nan), np.full((1, d), np.nan), np.full((1, d, d), np.nan), np.full(1, np.nan))
    for i in range(len(g)):
        try:
            one = solve(g[i:i + 1], cfg)
            if not all(np.isfinite(part).all() for part in one[:2]):
                raise np.linalg.LinAlgError("no finite solution")
            rows.append(one)
            status.append("ok")
        except (ValueError, np.linalg.LinAlgError) as error:
            rows.append(empty)
            status.append(f"failed: {error}")
    return tuple(np.concatenate(parts) for parts in zip(*rows)), status


def fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str,
        configs: Sequence[LinearConfig]) -> DataFrame:
    """One model per key and configuration from the train rows.

    A model that cannot be fitted is empty and says why; other keys and configurations go on.
    """
    width = len(features) + 2
    grams = gram(df.filter(F.col("split") == "train"), keys, [*features, y])
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *key_fields(df, keys), T.StructField("cfg_id", T.IntegerType()), T.StructField("intercept", T.DoubleType()),
        T.StructField("coef", doubles), T.StructField("center", doubles), T.StructField("cov", doubles),
        T.StructField("noise", T.DoubleType()), T.StructField("n_fit", T.LongType()),
        T.StructField("status", T.StringType())])
    names, grid = list(keys), list(configs)
    d = len(features)

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            g = unpack(pdf["m"], width)
            for cfg in grid:
                (w, b, mx, cov, noise), status = solve_each(g, cfg)
                out = pdf[names].copy()
                out["cfg_id"], out["intercept"], out["coef"], out["center"] = cfg.cfg_id, b, list(w), list(mx)
                out["cov"] = list(cov.reshape(len(cov), -1))
                out["noise"], out["n_fit"], out["status"] = noise, g[:, 0, 0].astype("int64"), status
                yield out

    models = grams.mapInPandas(fits, schema)
    return models.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("noise", "intercept")})


def spread(x: Column, center: Column, cov: Column) -> Column:
    """Quadratic form of the centred features with the coefficient covariance."""
    def form(xs: pd.Series, mids: pd.Series, covs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=float)
        c = np.stack(xs.to_numpy()).astype(float) - np.stack(mids.to_numpy())
        s = np.stack(covs.to_numpy()).reshape(len(c), c.shape[1], c.shape[1])
        return pd.Series(np.einsum("ni,nij,nj->n", c, s, c))

    return F.pandas_udf(form, T.DoubleType())(x, center, cov)


def predict(df: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str],
            interval: float | None = None) -> DataFrame:
    """Forecasts of all rows by the model of their key, for all configurations of ``models``.

    ``interval`` asks for bounds that many predictive deviations away (Bayesian methods).
    """
    out = attach(df, models, keys)
    total = F.col("intercept")
    for j, c in enumerate(features):
        total = total + F.col("coef")[j] * F.col(c).cast("double")
    out = out.withColumn("prediction", total)
    if interval is not None:
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
        sd = F.sqrt(spread(x, F.col("center"), F.col("cov")) + F.col("noise"))
        out = out.withColumns({"lower_conf": F.col("prediction") - F.lit(interval) * sd,
                               "upper_conf": F.col("prediction") + F.lit(interval) * sd,
                               "variance": sd * sd})
    return out.drop("intercept", "coef", "center", "cov", "noise", "n_fit", "status")


def _null_forecasts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in columns})


def rolling_origin(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str,
                   configs: Sequence[LinearConfig], interval: float | None = None, pos: str = "t") -> DataFrame:
    """One-step-ahead test forecasts per configuration, each by a model of all rows before it.

    The running sums are computed once; every configuration only solves them. With few features they
    are window sums per row. With many, only the sums of earlier chunks are, and the rows of a chunk
    add theirs one after the other. A row whose model cannot be fitted has a NULL forecast.
    """
    passed = [c for c in df.columns if c in {"ds", "fold"} - set(keys)]
    rows = df.select(*keys, pos, "split", *passed, *features, y)
    extra = ["prediction"] + (["lower_conf", "upper_conf", "variance"] if interval is not None else [])
    schema = T.StructType([*rows.schema.fields, T.StructField("cfg_id", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in extra]])
    order = [f.name for f in schema.fields]
    used, width, grid = [*features, y], len(features) + 2, list(configs)

    def forecasts(pdf: pd.DataFrame, g: np.ndarray) -> list[pd.DataFrame]:
        x, done = pdf[list(features)].to_numpy(float), []
        for cfg in grid:
            (w, b, mx, cov, noise), _ = solve_each(g, cfg)
            out = pdf.copy()
            out["cfg_id"] = cfg.cfg_id
            out["prediction"] = b + np.einsum("ni,ni->n", w, x)
            if interval is not None:
                out["variance"] = np.einsum("ni,nij,nj->n", x - mx, cov, x - mx) + noise
                half = interval * np.sqrt(out["variance"])
                out["lower_conf"], out["upper_conf"] = out["prediction"] - half, out["prediction"] + half
            done.append(out[order])
        return done

    def from_running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield from forecasts(pdf.drop(columns="m"), unpack(pdf["m"], width))

    def from_chunk(part: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="_chunk").sort_values(pos).reset_index(drop=True)
        z = part[used].to_numpy(float)
        ready = np.isfinite(z[:, :-1]).all(axis=1) & (part["split"] == "test").to_numpy()
        g, done = unpack(carried["m"], width)[0], []
        for start in range(0, len(part), WIDE_BATCH):
            stop = min(start + WIDE_BATCH, len(part))
            before, g = added(g, z[start:stop])
            test = ready[start:stop]
            if test.any():
                done += forecasts(part.iloc[start:stop][test], before[test])
        return pd.concat(done, ignore_index=True) if done else pd.DataFrame(columns=order)

    if len(pairs(width)) <= MAX_JVM_SUMS:
        running = running_gram(rows, keys, used, pos)
        tested = running.filter((F.col("split") == "test") & complete(features))
        return _null_forecasts(tested.mapInPandas(from_running, schema), extra)
    chunked = rows.withColumn("_chunk", chunk_index(pos, CHUNK_ROWS))
    carried = cut_lineage(carried_gram(chunked, keys, used))
    by = [*keys, "_chunk"]
    return _null_forecasts(chunked.groupBy(*by).cogroup(carried.groupBy(*by)).applyInPandas(from_chunk, schema), extra)


def grid_of(method: str, values: Mapping[str, Sequence]) -> list[LinearConfig]:
    """Configurations for all combinations of the given values."""
    configs = [LinearConfig(method=method)]
    for name, options in values.items():
        configs = [LinearConfig(**{**c.__dict__, name: v}) for c in configs for v in options]
    return [LinearConfig(**{**c.__dict__, "cfg_id": i}) for i, c in enumerate(configs)]
