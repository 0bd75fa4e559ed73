"""ARIMA(1,1,1) by exact Gaussian likelihood, all series of an Arrow batch at once.

The weeks of a series (at most one per calendar week) are packed into one row by Spark; a task then runs the Kalman recursion of
many series and many parameter values together, one array operation per week.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.names import DATE, KEYS, TARGET

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Series of one task, about; tasks at most; series whose recursions run together.
SERIES_PER_TASK, MOST_TASKS, TOGETHER = 64, 20_000, 256
#: Bound of both coefficients, inside which the process is stationary and invertible.
BOUND = 0.995
#: Starts beside the regression's own, as (ar, ma): likelihoods of these models may have two peaks.
STARTS = ((0.0, 0.0), (0.6, -0.3), (-0.6, 0.3), (0.3, -0.9))
ROUNDS, STEP = 60, 1e-4


def recursion(w: np.ndarray, n: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weighted squares, sum of log variances, next value, its variance) of ARMA(1,1) for series (rows) and parameters (columns).

    ``w`` holds the series, padded to one length, ``n`` their lengths; variances are relative to that of the shocks. The first
    variance is the stationary one; each later one follows from the one before, which is the Kalman filter of this model.
    """
    spread = (1 + 2 * ar * ma + ma**2) / (1 - ar**2)
    guess, squares, logs = np.zeros_like(ar), np.zeros_like(ar), np.zeros_like(ar)
    for t in range(w.shape[1]):
        live = (t < n)[:, None]
        error = w[:, t, None] - guess
        squares += np.where(live, error**2 / spread, 0.0)
        logs += np.where(live, np.log(spread), 0.0)
        guess = np.where(live, ar * w[:, t, None] + ma / spread * error, guess)
        spread = np.where(live, 1 + ma**2 - ma**2 / spread, spread)
    return squares, logs, guess, spread


def log_likelihood(w: np.ndarray, n: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood, variance of the shocks), the variance chosen best for the coefficients."""
    squares, logs, _, _ = recursion(w, n, ar, ma)
    size = n[:, None]
    variance = squares / size
    with np.errstate(divide="ignore"):
        return -0.5 * (size * (np.log(2 * np.pi * variance) + 1) + logs), variance


def regression_start(w: np.ndarray) -> tuple[float, float]:
    """Coefficients from two regressions: a long autoregression gives the shocks, then the values follow both."""
    lags = min(8, len(w) // 4)
    if lags < 1 or len(w) - lags < 6:
        return 0.0, 0.0
    past = np.stack([w[lags - k - 1:len(w) - k - 1] for k in range(lags)], axis=1)
    shocks = w[lags:] - past @ np.linalg.lstsq(past, w[lags:], rcond=None)[0]
    both = np.stack([w[lags:-1], shocks[:-1]], axis=1)
    found = np.linalg.lstsq(both, w[lags + 1:], rcond=None)[0]
    return float(np.clip(found[0], -0.9, 0.9)), float(np.clip(found[1], -0.9, 0.9))


def fit(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of greatest likelihood for each row: damped Newton steps from several starts, all at once.

    The search runs on the inverse hyperbolic tangent of the coefficients, so it stays inside the bound. A row of zeros gets zeros.
    """
    size = np.sqrt((w**2).sum(axis=1) / n)
    moves = size > 0
    x = w / np.where(moves, size, 1.0)[:, None]
    x[~moves, 0] = 1.0  # any series will do, the result is put to 0 below
    starts = np.array([[regression_start(row[:k]), *STARTS] for row, k in zip(x, n, strict=True)])
    place = np.arctanh(np.clip(starts, -0.95, 0.95) / BOUND)  # series, start, coefficient
    series, count = place.shape[:2]

    def value(at: np.ndarray) -> np.ndarray:
        """Minus the log likelihood at (series, start, point, coefficient)."""
        flat = BOUND * np.tanh(at.reshape(series, -1, 2))
        return -log_likelihood(x, n, flat[..., 0], flat[..., 1])[0].reshape(at.shape[:-1])

    around = STEP * np.array([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1)])
    scales = np.array([1.0, 0.5, 0.2, 0.05, 0.005])
    for _ in range(ROUNDS):
        v = value(place[:, :, None] + around)
        g = np.stack([v[..., 1] - v[..., 2], v[..., 3] - v[..., 4]], axis=-1) / (2 * STEP)
        a, b = ((v[..., i] - 2 * v[..., 0] + v[..., i + 1]) / STEP**2 for i in (1, 3))
        c = (v[..., 5] + v[..., 6] - 2 * v[..., 0] - STEP**2 * (a + b)) / (2 * STEP**2)
        # The least eigenvalue is raised above zero, so the step goes downhill.
        least = (a + b) / 2 - np.sqrt(((a - b) / 2) ** 2 + c**2)
        lift = np.maximum(0.0, 1e-2 - least) + 1e-9
        a, b = a + lift, b + lift
        step = -np.stack([b * g[..., 0] - c * g[..., 1], a * g[..., 1] - c * g[..., 0]], axis=-1) / (a * b - c**2)[..., None]
        step *= np.minimum(1.0, 1.5 / np.maximum(np.abs(step).max(axis=-1), 1e-12))[..., None]
        tries = np.concatenate([place[:, :, None], np.clip(place[:, :, None] + scales[:, None] * step[:, :, None], -4.0, 4.0)], axis=2)
        best = value(tries).argmin(axis=2)
        new = np.take_along_axis(tries, best[..., None, None], axis=2)[:, :, 0]
        done = np.abs(new - place).max() < 1e-7
        place = new
        if done:
            break
    winner = value(place[:, :, None])[..., 0].argmin(axis=1)
    found = BOUND * np.tanh(place[np.arange(series), winner])
    return np.where(moves, found[:, 0], 0.0), np.where(moves, found[:, 1], 0.0)


def forecast(y: Sequence[np.ndarray], steps: np.ndarray, ar: np.ndarray, ma: np.ndarray, variance: np.ndarray, guess: np.ndarray, spread: np.ndarray):
    """(forecasts, standard errors) of the level for each series: changes fade by the autoregression and are summed up."""
    out = []
    for k, values in enumerate(y):
        h = np.arange(int(steps[k]))
        change = guess[k] * ar[k] ** h
        fading = np.cumsum(ar[k] ** h)
        weights = np.cumsum(np.concatenate([[1.0], (ar[k] + ma[k]) * ar[k] ** h[:-1]])) if len(h) else np.zeros(0)
        # Shocks to come, and what is not known of the last one.
        error = np.sqrt(variance[k] * (np.cumsum(weights**2) + (spread[k] - 1) * fading**2))
        out.append((values[-1] + np.cumsum(change), error))
    return out


def _packed(split_df: DataFrame, keys: Sequence[str], target: str, fit_on: Sequence[str]) -> DataFrame:
    rows = split_df.where(F.col("split").isin(*fit_on, "test")).select(*keys, F.col(DATE).alias("_d"), F.col(target).cast("double").alias("_y"), "split")
    series = rows.select(*keys).distinct().count()
    week = F.struct("_d", "_y")
    fitted = F.col("split").isin(*fit_on) & F.col("_y").isNotNull()
    lists = rows.repartition(max(1, min(MOST_TASKS, -(-series // SERIES_PER_TASK))), *keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(fitted, week))).alias("_past"), F.sort_array(F.collect_list(F.when(F.col("split") == "test", week))).alias("_test"))
    return lists.select(*keys, F.col("_past._y").alias("_past"), F.col("_test._d").alias("_dates"), F.col("_test._y").alias("_actual"))


def arima_fits(
    split_df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, fit_on: Sequence[str] = ("train",), least: int = 10, at: tuple[float, float] | None = None
) -> DataFrame:
    """One row per series: keys, Weeks, AR, MA, Variance, Log_Likelihood, Status, and the lists Dates, Actual, Predicted, Std_Error.

    ``at`` sets the two coefficients instead of fitting them. A series of fewer than ``least`` weeks to fit on is "too short" and has
    no coefficients; one that never changes has a variance of 0, no likelihood, and forecasts without error.
    """
    keys, types = list(keys), dict(split_df.dtypes)
    if at is not None and max(map(abs, at)) >= 1:
        raise ValueError("both coefficients must lie between -1 and 1")
    numbers = ["AR", "MA", "Variance", "Log_Likelihood"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                yield solve(batch.iloc[first:first + TOGETHER])

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        past = [np.asarray(v, float) for v in batch["_past"]]
        weeks = np.array([len(v) for v in past])
        steps = np.array([len(v) for v in batch["_dates"]])
        enough = np.flatnonzero(weeks >= max(least, 3))
        out = batch[[*keys, "_dates", "_actual"]].rename(columns={"_dates": "Dates", "_actual": "Actual"})
        found = {c: [None] * len(batch) for c in numbers}
        predicted, errors = ([[None] * s for s in steps] for _ in range(2))
        if len(enough):
            n = weeks[enough] - 1
            w = np.zeros((len(enough), n.max()))
            for i, k in enumerate(enough):
                w[i, :n[i]] = np.diff(past[k])
            ar, ma = fit(w, n) if at is None else (np.full(len(enough), a, float) for a in at)
            likelihood, variance = (v[:, 0] for v in log_likelihood(w, n, ar[:, None], ma[:, None]))
            _, _, guess, spread = (v[:, 0] for v in recursion(w, n, ar[:, None], ma[:, None]))
            ahead = forecast([past[k] for k in enough], steps[enough], ar, ma, variance, guess, spread)
            for i, k in enumerate(enough):
                values = (ar[i], ma[i], variance[i], likelihood[i] if np.isfinite(likelihood[i]) else None)
                for c, v in zip(numbers, values, strict=True):
                    found[c][k] = v
                predicted[k], errors[k] = ahead[i][0].tolist(), ahead[i][1].tolist()
        return out.assign(Weeks=weeks, **found, Status=np.where(weeks >= max(least, 3), "ok", "too short"), Predicted=predicted, Std_Error=errors)

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [
        "Weeks int", *[f"{c} double" for c in numbers], "Status string", "Dates array<date>", "Actual array<double>", "Predicted array<double>", "Std_Error array<double>"])
    return _packed(split_df, keys, target, list(fit_on)).mapInPandas(run, schema)


def likelihood_forecast(fits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The forecasts of ``arima_fits`` week by week: keys, Date, Actual, Predicted, Std_Error, Status, Model."""
    weeks = fits.select(*keys, "Status", F.inline(F.arrays_zip("Dates", "Actual", "Predicted", "Std_Error")))
    return weeks.select(*keys, F.col("Dates").alias(DATE), "Actual", "Predicted", "Std_Error", "Status", F.lit("ARIMA").alias("Model"))
