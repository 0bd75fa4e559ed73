"""Models fitted to each series on its own: ARIMA (``arima_likelihood``), its seasonal form, and trend with yearly
seasonality (``trend_holidays``).

Spark groups the weeks of a series into one Arrow batch (a few hundred rows: one per week of the
calendar) and spreads the series over the cluster; NumPy only does the arithmetic of one fit.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.names import DATE, HOLIDAY, KEYS, TARGET
from shelfcast.operators.arima_likelihood import arima_fits, likelihood_forecast
from shelfcast.operators.trend_holidays import trend_fits, trend_forecast

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _residuals(w: np.ndarray, params: np.ndarray, season: int) -> np.ndarray:
    """Residuals of an ARMA(1,1)x(1,1) recursion for many parameter rows (ar, ma, AR, MA) at once."""
    ar, ma, sar, sma = params.T
    e = np.zeros((len(w), len(params)))
    start = season + 1 if season else 1
    for t in range(start, len(w)):
        guess = ar * w[t - 1] + ma * e[t - 1]
        if season:
            guess = guess + sar * (w[t - season] - ar * w[t - season - 1]) + sma * (e[t - season] + ma * e[t - season - 1])
        e[t] = w[t] - guess
    return e


def fit_arma(w: np.ndarray, season: int = 0) -> np.ndarray:
    """Parameters with the least conditional sum of squares, by a shrinking search inside (-1, 1)."""
    free = [0, 1, 2, 3] if season else [0, 1]
    best, width = np.zeros(4), 0.9
    points, rounds, shrink = (5, 6, 0.5) if season else (21, 3, 0.12)
    steps = np.linspace(-1.0, 1.0, points)
    for _ in range(rounds):
        grid = np.stack(np.meshgrid(*[steps] * len(free), indexing="ij"), axis=-1).reshape(-1, len(free))
        tries = np.tile(best, (len(grid), 1))
        tries[:, free] = np.clip(best[free] + width * grid, -0.98, 0.98)
        cost = (_residuals(w, tries, season) ** 2).sum(axis=0)
        best, width = tries[int(np.argmin(cost))], width * shrink
    return best


#: Fewest weeks that ARIMA is fitted to, and fewest differences beyond one season for its seasonal form.
ARIMA_WEEKS, SEASONAL_DIFFERENCES = 10, 20
#: Fewest weeks that the trend model is fitted to.
TREND_WEEKS = 20


def enough_for_arima(weeks: int, season: int = 0, least: int = ARIMA_WEEKS, beyond: int = SEASONAL_DIFFERENCES) -> bool:
    """Is a history long enough? The seasonal form needs ``season + beyond`` differences at distance ``season``."""
    return weeks - season - 1 >= season + beyond if season else weeks >= least


def forecast_arima(y: np.ndarray, steps: int, season: int = 0) -> np.ndarray:
    """(1,1,1)(1,1,1,season) by least conditional squares: difference, fit, extend, sum back up. NaN if the history is too short.

    Without a season this is ARIMA(1,1,1) by the same criterion.
    """
    if not enough_for_arima(len(y), season):
        return np.full(steps, np.nan)
    seasonal = y[season:] - y[:-season] if season else y
    w = np.diff(seasonal)
    params = fit_arma(w, season)
    e = list(_residuals(w, params[None, :], season)[:, 0])
    ar, ma, sar, sma = params
    path = list(w)
    for _ in range(steps):
        t = len(path)
        value = ar * path[t - 1] + ma * e[t - 1]
        if season:
            value += sar * (path[t - season] - ar * path[t - season - 1]) + sma * (e[t - season] + ma * e[t - season - 1])
        path.append(value)
        e.append(0.0)
    level = seasonal[-1] + np.cumsum(path[len(w):])
    if not season:
        return level
    full = list(y)
    for k in range(steps):
        full.append(level[k] + full[len(y) + k - season])
    return np.array(full[len(y):])


def _design(days: np.ndarray, holiday: np.ndarray, origin: float, span: float, waves: int) -> np.ndarray:
    angle = 2 * np.pi * days / 365.25
    cols = [np.ones_like(days), (days - origin) / span, holiday]
    for k in range(1, waves + 1):
        cols += [np.sin(k * angle), np.cos(k * angle)]
    return np.stack(cols, axis=1)


def forecast_trend_season(
    days: np.ndarray, y: np.ndarray, holiday: np.ndarray, future_days: np.ndarray, future_holiday: np.ndarray, waves: int = 10,
    least: int = TREND_WEEKS, floor_share: float = 1e-3, cap_factor: float | None = None,
) -> np.ndarray:
    """Straight trend, yearly waves and one holiday effect, multiplied: ridge least squares on the log of sales.

    A logarithm needs positive sales: weeks below ``floor_share`` of the mean level count as that much. ``cap_factor``
    limits forecasts to that multiple of the largest week; without it they are as the model has them. NaN if there are
    fewer than ``least`` weeks.
    """
    if len(y) < least:
        return np.full(len(future_days), np.nan)
    floor = max(np.abs(y).mean() * floor_share, 1e-9)
    span = max(days[-1] - days[0], 1.0)
    x = _design(days, holiday, days[0], span, waves)
    penalty = np.full(x.shape[1], 1e-2)
    penalty[0] = 0.0
    beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ np.log(np.maximum(y, floor)))
    out = np.exp(_design(future_days, future_holiday, days[0], span, waves) @ beta)
    return out if cap_factor is None else np.minimum(out, cap_factor * np.maximum(y, floor).max())


def _per_series(
    split_df: DataFrame,
    name: str,
    method: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray],
    keys: Sequence[str],
    target: str,
    fit_on: Sequence[str],
) -> DataFrame:
    """Run a forecast method on the fitted and the test part of each series.

    ``Status`` is "ok", or "too short" where the method gave no forecast and ``Predicted`` is NULL.
    Fitted on "train" alone, the steps after the last training week are set against the test weeks;
    with "val" added to ``fit_on`` the forecast starts right before them.
    """
    keys, fit_on = list(keys), list(fit_on)
    types = dict(split_df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{DATE} date", "Actual double", "Predicted double", "Status string"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(DATE)
        train = group[group["split"].isin(fit_on) & group[target].notna()]
        test = group[group["split"] == "test"]
        out = test[[*keys, DATE]].copy()
        out["Actual"] = test[target].astype("float64")
        out["Predicted"] = method(train, test) if len(test) else np.array([])
        out["Predicted"] = out["Predicted"].astype("float64").replace({np.nan: None})
        out["Status"] = np.where(out["Predicted"].isna(), "too short", "ok")
        return out

    needed = split_df.where(F.col("split").isin(*fit_on, "test")).select(
        *keys, DATE, target, F.col(HOLIDAY).cast("double").alias(HOLIDAY), "split"
    )
    fitted = needed.groupBy(*keys).applyInPandas(run, schema)
    return fitted.withColumn("Model", F.lit(name))


def arima_forecast(
    split_df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, fit_on: Sequence[str] = ("train",)
) -> DataFrame:
    """ARIMA(1,1,1) by exact likelihood; ``arima_likelihood`` also gives standard errors."""
    return likelihood_forecast(arima_fits(split_df, keys, target, fit_on, ARIMA_WEEKS), keys).drop("Std_Error")


def seasonal_arima_forecast(
    split_df: DataFrame,
    season: int = 52,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    fit_on: Sequence[str] = ("train",),
) -> DataFrame:
    """NULL forecasts where the history is too short for the seasonal terms (``enough_for_arima``)."""

    def method(train, test):
        return forecast_arima(train[target].to_numpy("float64"), len(test), season)

    return _per_series(split_df, "SARIMA", method, keys, target, fit_on)


def trend_season_forecast(
    split_df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, fit_on: Sequence[str] = ("train",)
) -> DataFrame:
    """Changing trend, waves of the year and holidays by name; ``trend_holidays`` also gives what was fitted."""
    return trend_forecast(trend_fits(split_df, keys, target, fit_on, TREND_WEEKS), keys)


def fit_status(forecasts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Model, Status, series and weeks: what a league leaves out because the history was too short."""
    return forecasts.groupBy("Model", "Status").agg(F.count_distinct(*keys).alias("Series"), F.count(F.lit(1)).alias("Weeks"))
