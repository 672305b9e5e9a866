"""Gaussian-process regression on inducing rows.

A key is described by a fixed number of its train rows, evenly spread in time. All rows enter through
product sums of their kernel values with these, so rows of any number are partial aggregates; with at
least as many inducing rows as train rows the result is the exact process. Kernels are compared by
log marginal likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.models.gram import complete, key_fields, unpack
from sparkcast.operators.chunks import attach
from sparkcast.operators.transform import scale_statistics, standardize


@dataclass(frozen=True)
class GpConfig:
    """A kernel as sum and product of bases, e.g. ``se + periodic(rq) * poly``, and its scales."""

    kernel: str = "se"
    noise: float = 0.1
    length: float = 1.0
    variance: float = 1.0
    period: float = 7.0
    constant_mean: bool = True


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1), 0.0))


def _shape(base: str, r: np.ndarray) -> np.ndarray:
    if base == "se":
        return np.exp(-0.5 * r ** 2)
    if base == "matern52":
        s = np.sqrt(5.0) * r
        return (1.0 + s + s ** 2 / 3.0) * np.exp(-s)
    return 1.0 / (1.0 + 0.5 * r ** 2)


def base_kernel(base: str, a: np.ndarray, b: np.ndarray, cfg: GpConfig) -> np.ndarray:
    if base == "white":
        return cfg.variance * (_distance(a, b) == 0)
    if base == "poly":
        return (cfg.variance * a @ b.T + 1.0) ** 3
    inner = re.fullmatch(r"periodic\((\w+)\)", base)
    if inner:
        r = np.sqrt((np.sin(np.pi * (a[:, None, :] - b[None, :, :]) / cfg.period) ** 2).sum(-1)) / cfg.length
        return cfg.variance * _shape(inner[1], r)
    return cfg.variance * _shape(base, _distance(a, b) / cfg.length)


def kernel(cfg: GpConfig, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products before sums."""
    total = 0.0
    for term in cfg.kernel.split(" + "):
        part = 1.0
        for factor in term.split(" * "):
            part = part * base_kernel(factor, a, b, cfg)
        total = total + part
    return total


def kernel_diagonal(cfg: GpConfig, a: np.ndarray) -> np.ndarray:
    return np.array([kernel(cfg, r[None, :], r[None, :])[0, 0] for r in a])


def _whiten(cfg: GpConfig, z: np.ndarray) -> np.ndarray:
    """``L^-1`` of the inducing rows' kernel matrix, nearly dependent directions left out."""
    k = kernel(cfg, z, z)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    good = values > 1e-10 * max(values.max(), 1e-300)
    return (vectors * np.where(good, 1.0 / np.sqrt(np.where(good, values, 1.0)), 0.0)).T


def inducing_rows(df: DataFrame, keys: Sequence[str], features: Sequence[str], count: int) -> DataFrame:
    """``z``: up to ``count`` train rows per key, evenly spread over its train positions."""
    last = F.col("n_train") - F.lit(1)
    step = F.greatest(F.lit(1.0), last / F.lit(max(count - 1, 1)))
    nearest = F.round(F.round(F.col("t") / step) * step)
    picked = df.filter((F.col("split") == "train") & (F.col("t") == nearest) & complete(features))
    return picked.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.array(F.col("t").cast("double"), *[F.col(c).cast("double") for c in features]))).alias("z"))


def gp_forecast(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, configs: Sequence[GpConfig],
                inducing: int = 24, standardize_x: bool = True, standardize_y: bool = True) -> DataFrame:
    """Add ``kernel, prediction, variance, lower_conf, upper_conf`` of the likeliest configuration."""
    columns, names, grid = list(features), list(keys), list(configs)
    rows = df.select(*keys, "t", "n_train", "split", *[F.col(c).cast("double").alias(c) for c in features],
                     F.col(y).cast("double").alias("_y"))
    if standardize_x:
        rows = standardize(rows, keys, columns)
    stats = scale_statistics(rows, keys, ["_y"])
    rows = attach(rows, stats, keys)
    if standardize_y:
        rows = rows.withColumn("_v", (F.col("_y") - F.col("_mean__y")) / F.col("_sd__y"))
    else:
        rows = rows.withColumn("_v", F.col("_y"))
    rows = attach(rows, inducing_rows(rows, keys, columns, inducing), keys).filter(complete(columns) & F.col("z").isNotNull())

    def phi(cfg: GpConfig, group: pd.DataFrame) -> np.ndarray:
        z = np.array([np.asarray(r, float) for r in group["z"].iloc[0]])[:, 1:]
        return kernel(cfg, group[columns].to_numpy(float), z) @ _whiten(cfg, z).T

    doubles = T.ArrayType(T.DoubleType())
    sums_schema = T.StructType([*key_fields(df, keys), T.StructField("cfg_id", T.IntegerType()), T.StructField("m", doubles)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, group in pdf.groupby(names, sort=False):
                for i, cfg in enumerate(grid):
                    p = phi(cfg, group)
                    k = np.column_stack([np.ones(len(p)), p, group["_v"].to_numpy(float)])
                    trace = kernel_diagonal(cfg, group[columns].to_numpy(float)).sum() - (p ** 2).sum()
                    out.append((*key, i, np.append((k.T @ k)[np.triu_indices(k.shape[1])], trace)))
            if out:
                yield pd.DataFrame(out, columns=[*names, "cfg_id", "m"])

    train = rows.filter((F.col("split") == "train") & F.col("_v").isNotNull())
    parts = train.mapInPandas(partial, sums_schema)
    sums = (parts.select(*keys, "cfg_id", F.posexplode("m").alias("_i", "_v"))
            .groupBy(*keys, "cfg_id", "_i").agg(F.sum("_v").alias("_v")).groupBy(*keys, "cfg_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("m")))
    model_schema = T.StructType([
        *key_fields(df, keys), T.StructField("cfg_id", T.IntegerType()), T.StructField("log_likelihood", T.DoubleType()),
        T.StructField("w", doubles), T.StructField("cov", doubles), T.StructField("mean", T.DoubleType())])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                cfg = grid[int(r["cfg_id"])]
                flat = np.asarray(r["m"], float)
                size = int((np.sqrt(8 * (len(flat) - 1) + 1) - 1) / 2)
                g = unpack([flat[:-1]], size)[0]
                n, mean = g[0, 0], g[0, -1] / g[0, 0] if cfg.constant_mean else 0.0
                pp = g[1:-1, 1:-1]
                py = g[1:-1, -1] - mean * g[0, 1:-1]
                yy = g[-1, -1] - 2 * mean * g[0, -1] + mean ** 2 * n
                a = np.eye(len(pp)) + pp / cfg.noise
                cov = np.linalg.inv(a)
                w = cov @ py / cfg.noise
                fit = -0.5 * (n * np.log(2 * np.pi * cfg.noise) + np.linalg.slogdet(a)[1]
                              + (yy - py @ w) / cfg.noise)
                out.append((*[r[k] for k in names], int(r["cfg_id"]), fit - 0.5 * max(flat[-1], 0.0) / cfg.noise,
                            w, cov.ravel(), mean))
            yield pd.DataFrame(out, columns=[f.name for f in model_schema.fields])

    models = sums.mapInPandas(learn, model_schema)
    best = (models.groupBy(*keys).agg(F.max_by(F.struct("cfg_id", "w", "cov", "mean"),
                                              F.struct("log_likelihood", -F.col("cfg_id"))).alias("_b"))
            .select(*keys, "_b.*"))
    out_schema = T.StructType([*key_fields(df, keys), T.StructField("t", T.LongType()), T.StructField("kernel", T.StringType()),
                               T.StructField("prediction", T.DoubleType()), T.StructField("variance", T.DoubleType())])

    def forecast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, group in pdf.groupby(names, sort=False):
                first = group.iloc[0]
                cfg = grid[int(first["cfg_id"])]
                p = phi(cfg, group)
                cov = np.asarray(first["cov"], float).reshape(p.shape[1], p.shape[1])
                out = group[[*names, "t"]].copy()
                own = kernel_diagonal(cfg, group[columns].to_numpy(float))
                var = np.maximum(own - (p ** 2).sum(1), 0.0) + np.einsum("ni,ij,nj->n", p, cov, p) + cfg.noise
                sd = group["_sd__y"].to_numpy(float) if standardize_y else np.ones(len(group))
                mid = group["_mean__y"].to_numpy(float) if standardize_y else np.zeros(len(group))
                out["kernel"] = cfg.kernel
                out["prediction"] = (p @ np.asarray(first["w"], float) + first["mean"]) * sd + mid
                out["variance"] = var * sd ** 2
                yield out

    scored = attach(rows, best, keys).filter(F.col("cfg_id").isNotNull()).mapInPandas(forecast, out_schema)
    half = 2.0 * F.sqrt("variance")
    scored = scored.withColumns({"lower_conf": F.col("prediction") - half, "upper_conf": F.col("prediction") + half})
    return df.join(scored, [*keys, "t"], "left")
