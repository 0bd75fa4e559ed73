"""Two-sided Student t tail probability for a column of (t, degrees of freedom) pairs."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for positive numbers: the series for large ones after a shift by 10."""
    shift = np.sum([np.log(x + k) for k in range(10)], axis=0)
    y = x + 10.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz evaluation), all rows at once."""
    swap = x > (a + 1.0) / (a + b + 2.0)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    inner = (x > 0.0) & (x < 1.0)
    safe = np.where(inner, x, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(safe) + b * np.log1p(-safe))
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(safe), 1.0 / away(1.0 - (a + b) * safe / (a + 1.0))
    total = d.copy()
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * safe / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * safe / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / away(1.0 + numerator * d)
            c = away(1.0 + numerator / c)
            step = c * d
            total = total * step
        if (np.abs(step - 1.0) < 1e-15).all():
            break
    out = np.where(inner, front * total / a, (x >= 1.0).astype(float))
    return np.where(swap, 1.0 - out, out)


def two_sided_p(t, dof) -> np.ndarray:
    """Two-sided tail of Student's t; NaN where t is unknown or there are no degrees of freedom, 0 where t is infinite."""
    t, dof = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(dof, dtype=float))
    out = np.full(t.shape, np.nan)
    known = ~np.isnan(t) & (dof > 0)
    out[known & np.isinf(t)] = 0.0
    use = known & ~np.isinf(t)
    if use.any():
        out[use] = incomplete_beta(dof[use] / 2.0, np.full(int(use.sum()), 0.5), dof[use] / (dof[use] + t[use] ** 2))
    return out


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Arrow-batched, one evaluation for all rows of a batch."""
    return pd.Series(two_sided_p(t.to_numpy(float, na_value=np.nan), dof.to_numpy(float, na_value=np.nan))).replace({np.nan: None}).astype("float64")
