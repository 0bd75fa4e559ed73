"""Sales as a changing trend, yearly waves and an effect of every holiday, multiplied; fitted to each series on its own.

The weeks of a series (at most one per calendar week) are packed into one row by Spark. A task reduces every series to the
products of its few columns and then runs one coordinate descent for many series together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.holidays import US_HOLIDAYS, holidays_of_weeks
from shelfcast.names import DATE, KEYS, TARGET

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES_PER_TASK, MOST_TASKS, TOGETHER = 64, 20_000, 256
#: Possible changes of the trend, evenly over this share of the history.
CHANGES, CHANGE_SHARE = 25, 0.8
#: Prior scales: changes of slope (two-sided exponential); level and slope, waves, holidays (normal).
CHANGE_SCALE, TREND_SCALE, WAVE_SCALE, HOLIDAY_SCALE = 0.05, 5.0, 10.0, 10.0
SWEEPS, NOISE_ROUNDS = 2_000, 3


def design(days: np.ndarray, holidays: Sequence[Sequence[str]], names: Sequence[str], origin: float, span: float, waves: int) -> np.ndarray:
    """Columns of level, slope, waves of the year and one mark per holiday."""
    angle = 2 * np.pi * days / 365.25
    cols = [np.ones_like(days), (days - origin) / span]
    for k in range(1, waves + 1):
        cols += [np.sin(k * angle), np.cos(k * angle)]
    marks = np.array([[name in (h if h is not None else ()) for name in names] for h in holidays], float).reshape(len(days), len(names))
    return np.column_stack([*cols, marks])


def bends(days: np.ndarray, at: np.ndarray, origin: float, span: float) -> np.ndarray:
    """What a change of slope at each day adds from there on."""
    return np.maximum((days[:, None] - at) / span, 0.0)


def change_days(days: np.ndarray) -> np.ndarray:
    """Days at which the trend may change, after the first one."""
    among = int(np.floor(len(days) * CHANGE_SHARE))
    count = min(CHANGES, among - 1)
    return days[np.linspace(0, among - 1, count + 1).round().astype(int)[1:]] if count > 0 else np.zeros(0)


def sparse_changes(gram: np.ndarray, pull: np.ndarray, penalty: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Least squares with a penalty on absolute values, for each row: coordinate descent, one coordinate of all series at a time."""
    found, width = start.copy(), np.einsum("bkk->bk", gram)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(found.shape[1]):
            rest = pull[:, j] - np.einsum("bk,bk->b", gram[:, j], found) + width[:, j] * found[:, j]
            new = np.sign(rest) * np.maximum(np.abs(rest) - penalty, 0.0) / np.where(width[:, j] > 1e-12, width[:, j], np.inf)
            moved = max(moved, float(np.abs(new - found[:, j]).max(initial=0.0)))
            found[:, j] = new
        if moved < 1e-8:
            break
    return found


def fit(columns: Sequence[np.ndarray], kinks: Sequence[np.ndarray], y: Sequence[np.ndarray], scales: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, changes of slope, noise, violation of the optimum) for each series.

    The most likely values under the prior scales. The noise is found from the residuals, starting with a straight trend; for given
    changes all other coefficients have a closed form, so the descent runs over the changes alone.
    """
    series, width, most = len(y), columns[0].shape[1], max(k.shape[1] for k in kinks)
    gram, cross, inner = np.zeros((series, width, width)), np.zeros((series, width, most)), np.zeros((series, most, most))
    pull, push = np.zeros((series, width)), np.zeros((series, most))
    for i, (z, k, v) in enumerate(zip(columns, kinks, y, strict=True)):
        m = k.shape[1]
        gram[i], cross[i, :, :m], inner[i, :m, :m], pull[i], push[i, :m] = z.T @ z, z.T @ k, k.T @ k, z.T @ v, k.T @ v
    changes = np.zeros((series, most))
    # The straight fit, almost without a prior, says how large the noise is.
    ridge = np.full(series, 1e-4)
    weights = 1 / scales**2
    for turn in range(NOISE_ROUNDS + 1):
        whole = gram + ridge[:, None, None] * np.diag(weights)
        solved = np.linalg.solve(whole, np.concatenate([cross, pull[..., None]], axis=2))
        if turn:
            reduced = inner - np.einsum("bpk,bpl->bkl", cross, solved[..., :-1])
            target = push - np.einsum("bpk,bp->bk", cross, solved[..., -1])
            changes = sparse_changes(reduced, target, ridge / CHANGE_SCALE, changes)
        coefficients = solved[..., -1] - np.einsum("bpk,bk->bp", solved[..., :-1], changes)
        residuals = [v - z @ coefficients[i] - k @ changes[i, :k.shape[1]] for i, (z, k, v) in enumerate(zip(columns, kinks, y, strict=True))]
        noise = np.array([np.sqrt(np.mean(r**2)) for r in residuals])
        if turn < NOISE_ROUNDS:
            ridge = np.maximum(noise, 1e-3) ** 2
    limit = ridge / CHANGE_SCALE
    gap = np.zeros(series)
    for i, (k, r) in enumerate(zip(kinks, residuals, strict=True)):
        slope, own = k.T @ r, changes[i, :k.shape[1]]
        off = np.where(own != 0, np.abs(slope - np.sign(own) * limit[i]), np.maximum(np.abs(slope) - limit[i], 0.0))
        gap[i] = off.max(initial=0.0) / limit[i]
    return coefficients, changes, noise, gap


def trend_fits(
    split_df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, fit_on: Sequence[str] = ("train",), least: int = 20, waves: int = 10,
    rules: Mapping = US_HOLIDAYS, days_before: int = 0, floor_share: float = 1e-3,
) -> DataFrame:
    """One row per series: keys, Weeks, Status, Slope, Noise, Gap, the lists Change_Days and Changes, Effects by holiday, and the
    lists Dates, Actual, Predicted.

    All are on the log of sales: weeks below ``floor_share`` of the mean level count as that much. ``Slope`` and ``Changes`` are per
    year. ``Gap`` is how far the changes are from the optimum, as a share of their penalty. A holiday that the history does not hold
    has no effect. ``days_before`` says where a week's date lies in it (``holidays_of_weeks``). Fewer than ``least`` weeks: "too short".
    """
    keys, types, names, fit_on = list(keys), dict(split_df.dtypes), list(rules), list(fit_on)
    scales = np.array([TREND_SCALE, TREND_SCALE, *[WAVE_SCALE] * (2 * waves), *[HOLIDAY_SCALE] * len(names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                yield solve(batch.iloc[first:first + TOGETHER])

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        steps, weeks = (np.array([len(v) for v in batch[c]]) for c in ("_dates", "_days"))
        enough = np.flatnonzero(weeks >= max(least, 2))
        out = batch[[*keys, "_dates", "_actual"]].rename(columns={"_dates": "Dates", "_actual": "Actual"})
        found = {c: [None] * len(batch) for c in ("Slope", "Noise", "Gap", "Change_Days", "Changes", "Effects")}
        predicted = [[None] * s for s in steps]
        if len(enough):
            days = [np.asarray(batch["_days"].iloc[k], float) for k in enough]
            sales = [np.asarray(batch["_past"].iloc[k], float) for k in enough]
            logs = [np.log(np.maximum(v, max(np.abs(v).mean() * floor_share, 1e-9))) for v in sales]
            spans = [max(d[-1] - d[0], 1.0) for d in days]
            at = [change_days(d) for d in days]
            marks = [batch["_marks"].iloc[k] for k in enough]
            columns = [design(d, m, names, d[0], s, waves) for d, m, s in zip(days, marks, spans, strict=True)]
            kinks = [bends(d, a, d[0], s) for d, a, s in zip(days, at, spans, strict=True)]
            coefficients, changes, noise, gap = fit(columns, kinks, logs, scales)
            for i, k in enumerate(enough):
                later = np.asarray(batch["_test_days"].iloc[k], float)
                own, year = changes[i, :len(at[i])], 365.25 / spans[i]
                if len(later):
                    ahead = design(later, batch["_test_marks"].iloc[k], names, days[i][0], spans[i], waves) @ coefficients[i]
                    predicted[k] = np.exp(ahead + bends(later, at[i], days[i][0], spans[i]) @ own).tolist()
                seen = columns[i][:, -len(names):].any(axis=0) if names else []
                found["Slope"][k], found["Noise"][k], found["Gap"][k] = coefficients[i, 1] * year, noise[i], gap[i]
                found["Change_Days"][k], found["Changes"][k] = at[i].astype(int).tolist(), (own * year).tolist()
                found["Effects"][k] = {n: float(coefficients[i, 2 + 2 * waves + j]) for j, n in enumerate(names) if seen[j]}
        return out.assign(Weeks=weeks, Status=np.where(weeks >= max(least, 2), "ok", "too short"), **found, Predicted=predicted)

    rows = split_df.where(F.col("split").isin(*fit_on, "test")).select(*keys, F.col(DATE).alias("_d"), F.col(target).cast("double").alias("_y"), "split")
    lists = holidays_of_weeks(rows, "_d", rules, days_before).groupBy("_d").agg(F.sort_array(F.collect_set("Holiday")).alias("_h"))
    series = rows.select(*keys).distinct().count()
    week = F.struct("_d", "_y", F.coalesce("_h", F.array().cast("array<string>")).alias("_h"))
    fitted = F.col("split").isin(*fit_on) & F.col("_y").isNotNull()
    packed = rows.join(lists, "_d", "left").repartition(max(1, min(MOST_TASKS, -(-series // SERIES_PER_TASK))), *keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(fitted, week))).alias("_fit"), F.sort_array(F.collect_list(F.when(F.col("split") == "test", week))).alias("_test"))
    days = lambda c: F.transform(f"{c}._d", F.unix_date)
    packed = packed.select(
        *keys, days("_fit").alias("_days"), F.col("_fit._y").alias("_past"), F.col("_fit._h").alias("_marks"),
        F.col("_test._d").alias("_dates"), days("_test").alias("_test_days"), F.col("_test._y").alias("_actual"), F.col("_test._h").alias("_test_marks"))
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [
        "Weeks int, Status string, Slope double, Noise double, Gap double, Change_Days array<int>, Changes array<double>, Effects map<string,double>, "
        "Dates array<date>, Actual array<double>, Predicted array<double>"])
    return packed.mapInPandas(run, schema).withColumn("Change_Days", F.transform("Change_Days", F.date_from_unix_date))


def trend_forecast(fits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The forecasts of ``trend_fits`` week by week: keys, Date, Actual, Predicted, Status, Model."""
    weeks = fits.select(*keys, "Status", F.inline(F.arrays_zip("Dates", "Actual", "Predicted")))
    return weeks.select(*keys, F.col("Dates").alias(DATE), "Actual", "Predicted", "Status", F.lit("Prophet").alias("Model"))
