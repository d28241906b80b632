"""Forecasts per series: a seasonal profile, a trend and an autoregression on what is left.

One model is fitted per id in a task of its own, from an evenly spaced series of
bounded length; series are independent, so they spread over the cluster. It
stands in for hosted forecasting models: the output columns agree, the numbers
are this model's own.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "forecast_timestamp timestamp_ntz, forecast_value double, prediction_interval_lower_bound double, prediction_interval_upper_bound double"


def cleaned(y: np.ndarray, width: float = 6.0) -> np.ndarray:
    """Spikes and dips beyond so many absolute deviations drawn in; gaps interpolated."""
    y = y.astype(float)
    known = np.flatnonzero(np.isfinite(y))
    if not len(known):
        return np.zeros(len(y))
    middle = np.median(y[known])
    spread = 1.4826 * np.median(np.abs(y[known] - middle))
    if spread > 0:
        y[known] = np.clip(y[known], middle - width * spread, middle + width * spread)
    return np.interp(np.arange(len(y)), known, y[known])


def seasonal_forecast(y: np.ndarray, horizon: int, confidence: float = 0.9, season: int = 24, order: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, lower, upper) for the steps after the series."""
    y = cleaned(y)
    n, t = len(y), np.arange(len(y))
    season = season if n >= 2 * season else 1
    x = np.concatenate([np.eye(season)[t % season], (t / max(1, n))[:, None] * (n >= 3 * season)], axis=1)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    order = min(order, max(0, (n - 1) // 4))
    phi = np.zeros(order)
    if order:
        lags = np.stack([rest[order - k - 1 : n - k - 1] for k in range(order)], axis=1)
        phi, *_ = np.linalg.lstsq(lags, rest[order:], rcond=None)
        if np.abs(phi).sum() >= 1:
            phi = phi / np.abs(phi).sum() * 0.98  # it fades out
        sigma = float(np.std(rest[order:] - lags @ phi))
    else:
        sigma = float(np.std(rest))
    future = np.arange(n, n + horizon)
    fx = np.concatenate([np.eye(season)[future % season], (future / max(1, n))[:, None] * (n >= 3 * season)], axis=1)
    past, psi, out, widths = list(rest[::-1][:order]), [1.0], [], []
    for h in range(horizon):
        step = float(np.dot(phi, past[:order])) if order else 0.0
        out.append(step)
        past.insert(0, step)
        widths.append(np.sqrt(np.sum(np.square(psi))))
        psi.append(float(sum(phi[k] * psi[h - k] for k in range(min(order, h + 1)))))
    value = fx @ beta + np.array(out)
    half = NormalDist().inv_cdf(0.5 + confidence / 2) * sigma * np.array(widths)
    return value, value - half, value + half


def forecast(df: DataFrame, time: str, value: str, ids: list[str] | None = None, horizon: int = 24, confidence: float = 0.9, season: int = 24) -> DataFrame:
    """Per id, `horizon` hourly steps after its last hour. Input: a row per id and hour; hours may be missing."""
    ids = ids or []
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = rows.dropna(subset=[value]).groupby(time)[value].mean().sort_index()
        if s.empty:
            return pd.DataFrame({c.split()[0]: [] for c in [*ids, *OUTPUT.split(", ")]})
        hours = pd.date_range(s.index[0], s.index[-1], freq="h")
        v, low, high = seasonal_forecast(s.reindex(hours).to_numpy(float), horizon, confidence, season)
        out = pd.DataFrame({"forecast_timestamp": pd.date_range(hours[-1], periods=horizon + 1, freq="h")[1:], "forecast_value": v, "prediction_interval_lower_bound": low, "prediction_interval_upper_bound": high})
        for c in reversed(ids):
            out.insert(0, c, rows[c].iloc[0])
        return out

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in ids], OUTPUT])
    return df.select(*ids, time, value).groupBy(*(ids or [F.lit(0)])).applyInPandas(run, schema)


def backtest(forecasts: DataFrame, actuals: DataFrame, time: str, value: str, ids: list[str] | None = None) -> DataFrame:
    """Forecasts beside what came: absolute error, and whether it lay in the interval."""
    on = [*(ids or []), "forecast_timestamp"]
    joined = forecasts.join(actuals.withColumnsRenamed({time: "forecast_timestamp", value: "actual"}).where("actual is not null"), on)
    inside = F.col("actual").between(F.col("prediction_interval_lower_bound"), F.col("prediction_interval_upper_bound"))
    return joined.select(
        *on, F.round("forecast_value", 1).alias("forecast_seconds"), F.round("actual", 1).alias("actual_seconds"), F.round(F.abs(F.col("forecast_value") - F.col("actual")), 1).alias("absolute_error"),
        F.when(inside, "YES").otherwise("NO").alias("within_confidence_interval"), F.round("prediction_interval_lower_bound", 1).alias("lower_bound"), F.round("prediction_interval_upper_bound", 1).alias("upper_bound"),
    )
