"""Recursive smoothing, one series at a time: built-in window frames cannot refer to their own results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import timeparse

#: Smoothing weights of level, trend and season (fixed values).
ALPHA, BETA, GAMMA = 0.1, 0.0035, 0.1


def ema(values: np.ndarray, n: int) -> np.ndarray:
    """Exponential moving average; the first result is the mean of the first n points."""
    out = np.full(len(values), np.nan)
    if n < 1 or len(values) < n:
        return out
    seed = values[:n]
    seed = seed[~np.isnan(seed)]
    state = seed.mean() if len(seed) else np.nan
    out[n - 1] = state
    a = 2 / (n + 1)
    for i in range(n, len(values)):
        v = values[i]
        if not np.isnan(v):
            state = v if np.isnan(state) else a * v + (1 - a) * state
            out[i] = state
    return out


def exponential(dense: DataFrame, size: int | str) -> DataFrame:
    """sid, ts, value of a dense grid (sid, ts, step, value)."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        n = int(size) if not isinstance(size, str) else max(1, abs(timeparse.duration(size)) // int(p["step"].iloc[0]))
        v = ema(p["value"].to_numpy(float), n)
        return pd.DataFrame({"sid": p["sid"], "ts": p["ts"], "value": v}).dropna()

    return dense.select("sid", "ts", "step", "value").groupBy("sid").applyInPandas(of, "sid bigint, ts bigint, value double")


def seasonal(values: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """Additive forecast of each point from those before it, and the smoothed size of its error."""
    n, m = len(values), max(1, season)
    forecast, deviation = np.full(n, np.nan), np.zeros(n)
    level, trend, cycle, spread = np.nan, 0.0, np.zeros(m), np.zeros(m)
    for i, y in enumerate(values):
        k = i % m
        if np.isnan(level):
            if not np.isnan(y):
                level = y
            continue
        forecast[i], deviation[i] = level + trend + cycle[k], spread[k]
        if np.isnan(y):
            level += trend
            continue
        before = level
        level = ALPHA * (y - cycle[k]) + (1 - ALPHA) * (level + trend)
        trend = BETA * (level - before) + (1 - BETA) * trend
        cycle[k] = GAMMA * (y - level) + (1 - GAMMA) * cycle[k]
        spread[k] = GAMMA * abs(y - forecast[i]) + (1 - GAMMA) * spread[k]
    return forecast, deviation


def holt_winters(dense: DataFrame, seasonality: int) -> DataFrame:
    """sid, ts, value, forecast, deviation of a dense grid."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        f, d = seasonal(p["value"].to_numpy(float), seasonality // int(p["step"].iloc[0]))
        return pd.DataFrame({"sid": p["sid"], "ts": p["ts"], "value": p["value"], "forecast": f, "deviation": d}).dropna(subset=["forecast"])

    return dense.select("sid", "ts", "step", "value").groupBy("sid").applyInPandas(of, "sid bigint, ts bigint, value double, forecast double, deviation double")
