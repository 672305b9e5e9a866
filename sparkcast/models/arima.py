"""Seasonal autoregression with moving-average and exogenous terms as two regressions.

A long autoregression gives residuals; a second regression on lags of the differenced target, lags of
these residuals and exogenous columns is the model (Hannan and Rissanen, 1982). Both are product
sums per key, so no step is longer than a window over a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.models.linear import LinearConfig, fit
from sparkcast.models.relay import RELAY_ROWS, relay
from sparkcast.operators.chunks import attach, windowed
from sparkcast.operators.clean import null_free_columns
from sparkcast.operators.lags import difference, difference_weights, undo_difference
from sparkcast.operators.profile import Z95
from sparkcast.operators.transform import backward, forward


@dataclass(frozen=True)
class ArimaConfig:
    """Orders ``(p, d, q)(P, D, Q)`` with a season, and the target transform."""

    p: int = 1
    d: int = 0
    q: int = 0
    seasonal_p: int = 0
    seasonal_d: int = 0
    seasonal_q: int = 0
    season: int = 7
    transf: str | None = None

    def lags(self, short: int, long: int) -> list[int]:
        return sorted({i + j * self.season for i in range(short + 1) for j in range(long + 1)} - {0})

    @property
    def ar_lags(self) -> list[int]:
        return self.lags(self.p, self.seasonal_p)

    @property
    def ma_lags(self) -> list[int]:
        return self.lags(self.q, self.seasonal_q)

    @property
    def long_lags(self) -> list[int]:
        """The long autoregression covers both kinds of lags and a few more short ones."""
        return sorted({*range(1, self.p + self.q + 3), *self.ar_lags, *self.ma_lags})


def _lagged(df: DataFrame, keys: Sequence[str], column: str, lags: Sequence[int], prefix: str) -> DataFrame:
    if not lags:
        return df
    return windowed(df, keys, "t", lambda make: {
        f"{prefix}{i}": F.lag(column, i).over(make()) for i in lags}, back=max(lags))


def _fitted(df: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], name: str) -> DataFrame:
    total = F.col("intercept")
    for j, c in enumerate(features):
        total = total + F.col("coef")[j] * F.col(c)
    return attach(df, models, keys).withColumn(name, total)


def arima_forecast(df: DataFrame, keys: Sequence[str], y: str, cfg: ArimaConfig, exog: Sequence[str] = (),
                   one_step: bool = True, size: int = RELAY_ROWS) -> DataFrame:
    """Add ``prediction, lower_conf, upper_conf`` to a split frame, with 95 percent bounds.

    Coefficients come from train. One-step forecasts use all earlier actuals; otherwise test rows are
    forecast from the end of train, forecasts standing in for the actuals. Exogenous columns with a
    NULL in train are left out.
    """
    exog = null_free_columns(df, exog, F.col("split") == "train") if exog else []
    shown = forward(df, keys, y, cfg.transf)
    kept = [c for c in shown.columns if c not in df.columns]
    rows = shown.select(*keys, "t", "split", *exog, *kept, F.col(y).cast("double").alias("_y"))
    weights = difference_weights(cfg.d, cfg.seasonal_d, cfg.season)
    rows = difference(rows, keys, "t", "_y", cfg.d, cfg.seasonal_d, cfg.season, "_w")
    long, ar, ma = cfg.long_lags, cfg.ar_lags, cfg.ma_lags
    ols = [LinearConfig("ols")]
    rows = _lagged(rows, keys, "_w", sorted({*ar, *(long if ma else [])}), "_w")
    if ma:
        first = [f"_w{i}" for i in long]
        stage = fit(rows, keys, first, "_w", ols).select(*keys, "intercept", "coef")
        rows = _fitted(rows, stage, keys, first, "_long").withColumn("_e", F.col("_w") - F.col("_long"))
        rows = _lagged(rows.drop("intercept", "coef", "_long"), keys, "_e", ma, "_e")
    features = [*[f"_w{i}" for i in ar], *[f"_e{i}" for i in ma], *exog]
    if not features:
        rows = rows.withColumn("_none", F.lit(0.0))
        features = ["_none"]
    model = fit(rows, keys, features, "_w", ols).select(*keys, "intercept", "coef", "noise")
    if not one_step:
        rows = _from_train_end(rows, keys, model, cfg, exog, size)
    else:
        rows = _fitted(rows, model, keys, features, "_what")
        rows = windowed(rows, keys, "t", lambda make: {
            "prediction": undo_difference(F.col("_what"), lambda i: F.lag("_y", i).over(make()),
                                          cfg.d, cfg.seasonal_d, cfg.season)}, back=max(weights))
    half = F.lit(Z95) * F.sqrt("noise")
    out = rows.withColumns({"lower_conf": F.col("prediction") - half, "upper_conf": F.col("prediction") + half})
    out = backward(out, y, cfg.transf, ["prediction", "lower_conf", "upper_conf"])
    return df.join(out.select(*keys, "t", "prediction", "lower_conf", "upper_conf"), [*keys, "t"], "left")


def _from_train_end(rows: DataFrame, keys: Sequence[str], model: DataFrame, cfg: ArimaConfig,
                    exog: Sequence[str], size: int) -> DataFrame:
    """Recursive forecasts: the state is the coefficients and the values the longest lag needs."""
    ar, ma = cfg.ar_lags, cfg.ma_lags
    undo = {lag: w for lag, w in difference_weights(cfg.d, cfg.seasonal_d, cfg.season).items() if lag}
    depth = max([1, *ar, *ma, *undo])
    n_coef = max(len(ar) + len(ma) + len(exog), 1) + 1
    names = list(exog)

    def step(pdf: pd.DataFrame, state: np.ndarray):
        coef = state[:n_coef]
        w, e, v = (list(part) for part in state[n_coef:].reshape(3, depth))
        x = pdf[names].to_numpy(float) if names else np.zeros((len(pdf), 0))
        test, actual = (pdf["split"] == "test").to_numpy(), pdf["_y"].to_numpy(float)
        residual = pdf["_e"].to_numpy(float)
        out = np.empty(len(pdf))
        for i in range(len(pdf)):
            z = [*[w[-k] for k in ar], *[e[-k] for k in ma], *x[i]] or [0.0]
            guess = coef[0] + float(np.dot(coef[1:], z))
            base = -sum(c * v[-k] for k, c in undo.items())
            out[i] = guess + base
            value = out[i] if test[i] or not np.isfinite(actual[i]) else actual[i]
            now = value - base
            error = 0.0 if test[i] or not np.isfinite(residual[i]) else residual[i]
            w, e, v = [*w[1:], now], [*e[1:], error], [*v[1:], value]
        return out, np.concatenate([coef, w, e, v])

    empty = F.array_repeat(F.lit(float("nan")), depth)
    start = model.select(*keys, F.concat(
        F.array("intercept"), "coef", empty, F.array_repeat(F.lit(0.0), depth), empty).alias("state"))
    known = rows if ma else rows.withColumn("_e", F.lit(0.0))
    predictions, _ = relay(known.select(*keys, "t", "split", *exog, "_y", "_e"), keys, start, step, size)
    return attach(rows.join(predictions, [*keys, "t"], "left"), model.select(*keys, "noise"), keys)
