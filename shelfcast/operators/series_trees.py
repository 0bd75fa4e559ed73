"""Tree models fitted to each series on its own: boosted trees with early stopping, random forests, their mean.

Spark groups the weeks of a series (at most one row per calendar week) and spreads the series over the cluster; all
models of a series are fitted in one pass over its rows, so a study reads the weekly table once however many models it
compares. A series is small, so splits are exact; the published numbers of trees take about a second a series and model, so
series are dealt to tasks by their number, not by the bytes of their rows.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.names import DATE, KEYS, TARGET
from shelfcast.operators import learners
from shelfcast.operators.learners import MODEL_FEATURES, Boosting, Forest, numeric

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
# So do the settings, whose classes are defined there.
cloudpickle.register_pickle_by_value(learners)

#: Series of one task, about, and tasks at most.
SERIES_PER_TASK, MOST_TASKS = 4, 20_000

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float, gains: np.ndarray) -> Tree:
    """(feature, threshold, first child, value) of one tree that lowers the squared loss given by gradients and weights.

    All nodes of a level are split at once: every point of every feature is tried, in the order of node and value. Ties go
    to the first feature, then the least value. ``gains`` collects the gain by feature.
    """
    n = len(g)
    by_value = np.argsort(x, axis=0, kind="stable")
    node = np.zeros(n, np.int64)
    feature, threshold, child = [np.array([-1])], [np.zeros(1)], [np.zeros(1, np.int64)]
    first, count = 0, 1  # the nodes of the level
    for _ in range(depth):
        place = node - first
        place[place < 0] = count  # rows of finished leaves go last
        order = np.take_along_axis(by_value, np.argsort(place[by_value], axis=0, kind="stable"), axis=0)
        rank = np.sort(place)
        start = np.searchsorted(rank, np.arange(count))
        value = np.take_along_axis(x, order, axis=0)
        sums = [np.cumsum(w[order], axis=0) for w in (g, h)]
        totals = [np.bincount(place, w, minlength=count + 1)[:, None] for w in (g, h)]
        before = [np.concatenate([np.zeros((1, x.shape[1])), c])[np.append(start, n)] for c in sums]
        left_g, left_h = (c - p[rank] for c, p in zip(sums, before, strict=True))
        all_g, all_h = (t[rank] for t in totals)
        right_g, right_h = all_g - left_g, all_h - left_h
        inner = np.append(rank[1:] == rank[:-1], False) & (rank < count)
        fine = inner[:, None] & (left_h >= least) & (right_h >= least)
        fine[:-1] &= value[1:] > value[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
        gain = np.where(fine, gain, 0.0)
        most = np.maximum.reduceat(gain, start, axis=0)
        column = most.argmax(axis=1)
        best = most[np.arange(count), column]
        split = best > 1e-9
        if not split.any():
            break
        column_of, best_of = np.append(column, 0)[rank], np.append(best, np.inf)[rank]
        at = np.where(gain[np.arange(n), column_of] == best_of, np.arange(n), n)
        at = np.minimum.reduceat(at, start)[split]
        j = column[split]
        np.add.at(gains, j, best[split])
        cut = np.zeros(count)
        cut[split] = (value[at, j] + value[at + 1, j]) / 2
        new = np.zeros(count, np.int64)
        new[split] = first + count + 2 * np.arange(len(j))
        feature[-1], threshold[-1], child[-1] = np.where(split, column, -1), cut, new
        moved = (place < count) & np.append(split, False)[place]
        where = place[moved]
        node[moved] = new[where] + (x[moved, column[where]] > cut[where])
        first, count = first + count, 2 * len(j)
        feature.append(np.full(count, -1))
        threshold.append(np.zeros(count))
        child.append(np.zeros(count, np.int64))
    size = first + count
    sum_g, sum_h = (np.bincount(node, w, minlength=size) for w in (g, h))
    with np.errstate(divide="ignore", invalid="ignore"):
        leaf = np.where(sum_h + ridge > 0, -sum_g / (sum_h + ridge), 0.0)
    return np.concatenate(feature), np.concatenate(threshold), np.concatenate(child), leaf


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The tree's value for every row, all rows one level at a time."""
    feature, threshold, child, value = tree
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return value[node]
        right = x[rows, np.maximum(feature[node], 0)] > threshold[node]
        node = np.where(inner, child[node] + right, node)


def boost(
    x: np.ndarray, y: np.ndarray, settings: Boosting, watch: tuple[np.ndarray, np.ndarray] | None, others: Sequence[np.ndarray], grown: list[Tree] | None = None
) -> tuple[list[np.ndarray], int, np.ndarray]:
    """(predictions for each of ``others``, trees kept, gain by feature) of boosted trees with ridge-regularised leaves.

    With ``early_stop`` the fit ends when the error on ``watch`` has not improved for ``patience`` trees, and the trees
    after the best one are dropped. ``grown`` receives the trees that stay, their leaves multiplied by the rate.
    """
    rng = np.random.default_rng(settings.seed)
    n, width = x.shape
    columns = max(1, round(settings.feature_share * width))
    start = float(y.mean())
    fit, out = np.full(n, start), [np.full(len(o), start) for o in others]
    gains = np.zeros(width)
    stop = settings.early_stop and watch is not None and len(watch[1]) > 0
    seen = np.full(len(watch[1]), start) if stop else None
    best, best_at, best_state = np.inf, 0, ([o.copy() for o in out], gains.copy())
    for k in range(settings.trees):
        used = np.sort(rng.choice(width, columns, replace=False)) if columns < width else np.arange(width)
        rows = np.flatnonzero(rng.random(n) < settings.row_share) if settings.row_share < 1 else np.arange(n)
        gained = np.zeros(columns)
        tree = grow(x[rows][:, used], (fit - y)[rows], np.ones(len(rows)), settings.depth, 1.0, 1.0, gained)
        gains[used] += gained
        if grown is not None:
            grown.append((np.where(tree[0] >= 0, used[np.maximum(tree[0], 0)], -1), *tree[1:3], settings.rate * tree[3]))
        fit += settings.rate * walk(tree, x[:, used])
        for o, rest in zip(out, others, strict=True):
            o += settings.rate * walk(tree, rest[:, used])
        if stop:
            seen += settings.rate * walk(tree, watch[0][:, used])
            error = float(np.mean((seen - watch[1]) ** 2))
            if error < best:
                best, best_at, best_state = error, k + 1, ([o.copy() for o in out], gains.copy())
            elif k + 1 - best_at >= settings.patience:
                break
    if stop and grown is not None:
        del grown[best_at:]
    return (*((best_state[0], best_at) if stop else (out, settings.trees)), best_state[1] if stop else gains)


def forest(
    x: np.ndarray, y: np.ndarray, settings: Forest, others: Sequence[np.ndarray], grown: list[Tree] | None = None
) -> tuple[list[np.ndarray], int, np.ndarray]:
    """(predictions, trees, gain by feature) of the mean of trees on bootstrap samples; every split tries all features.

    ``grown`` receives the trees, their leaves divided by the number of trees.
    """
    rng = np.random.default_rng(settings.seed)
    out, gains = [np.zeros(len(o)) for o in others], np.zeros(x.shape[1])
    for _ in range(settings.trees):
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        rows = np.flatnonzero(weight)
        tree = grow(x[rows], -(y * weight)[rows], weight[rows], settings.depth, 0.0, float(settings.min_leaf), gains)
        if grown is not None:
            grown.append((*tree[:3], tree[3] / settings.trees))
        for o, rest in zip(out, others, strict=True):
            o += walk(tree, rest) / settings.trees
    return out, settings.trees, gains


def _prepared(parts: DataFrame, features: Sequence[str], keys: Sequence[str], target: str, used: Sequence[str]) -> DataFrame:
    ids = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    rows = parts.where(F.col("split").isin(*used) & F.col(target).isNotNull())
    rows = numeric(rows.select(*ids, F.col(DATE).alias("_date"), F.col("split").alias("_split"), F.col(target).cast("double").alias("_y"), *features), features)
    # Dealt by the number of series, which the adaptive planner keeps: by bytes, hundreds of fits would share a task.
    names = [f"_key_{i}" for i in range(len(keys))]
    series = rows.select(*names).distinct().count()
    return rows.repartition(max(1, min(MOST_TASKS, -(-series // SERIES_PER_TASK))), *names)


def _fitted(group: pd.DataFrame, features: list[str], model: Boosting | Forest, fit_on: Sequence[str], rest: np.ndarray):
    x, y, split = group[features].to_numpy(float), group["_y"].to_numpy(float), group["_split"]
    here = split.isin(fit_on).to_numpy()
    if not here.any():
        return np.full(len(rest), np.nan), 0, np.zeros(len(features))
    if isinstance(model, Forest):
        found, trees, gains = forest(x[here], y[here], model, [rest])
    else:
        val = (split == "val").to_numpy() & ~here
        found, trees, gains = boost(x[here], y[here], model, (x[val], y[val]), [rest])
    return found[0], trees, gains


def series_models(
    parts: DataFrame,
    models: Mapping[str, Boosting | Forest],
    features: Sequence[str] = MODEL_FEATURES,
    fit_on: Sequence[str] = ("train",),
    predict_on: Sequence[str] = ("test",),
    ensemble: str | None = None,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
) -> DataFrame:
    """Predictions of all ``models``, fitted per series on the parts ``fit_on``: keys, Date, split, Actual, Predicted, Model, Trees.

    ``ensemble`` names one more, the mean of all others. Early stopping watches the "val" part, which must not be fitted
    on then. A series without rows to fit on gets NULL predictions and 0 trees.
    """
    if "val" in fit_on and any(isinstance(m, Boosting) and m.early_stop for m in models.values()):
        raise ValueError("early stopping watches the validation part, so no model may be fitted on it")
    keys, features, types = list(keys), list(features), dict(parts.dtypes)
    used = sorted({*fit_on, *predict_on, *(["val"] if any(getattr(m, "early_stop", False) for m in models.values()) else [])})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_date")
        later = group[group["_split"].isin(predict_on)]
        rest = later[features].to_numpy(float)
        blocks = []
        for name, model in models.items():
            predicted, trees, _ = _fitted(group, features, model, fit_on, rest)
            blocks.append((name, predicted, trees))
        if ensemble:
            blocks.append((ensemble, np.mean([b[1] for b in blocks], axis=0), sum(b[2] for b in blocks)))
        ids = later[[*[f"_key_{i}" for i in range(len(keys))], "_date", "_split", "_y"]]
        out = [ids.assign(Predicted=pd.Series(p, index=ids.index).astype(object).where(~np.isnan(p), None), Model=name, Trees=trees) for name, p, trees in blocks]
        return pd.concat(out)

    schema = ", ".join([f"_key_{i} {types[k]}" for i, k in enumerate(keys)] + ["_date date", "_split string", "_y double", "Predicted double", "Model string", "Trees int"])
    fitted = _prepared(parts, features, keys, target, used).groupBy(*[f"_key_{i}" for i in range(len(keys))]).applyInPandas(run, schema)
    names = [F.col(f"_key_{i}").alias(k) for i, k in enumerate(keys)]
    return fitted.select(*names, F.col("_date").alias(DATE), F.col("_split").alias("split"), F.col("_y").alias("Actual"), "Predicted", "Model", "Trees")


def series_importance(
    parts: DataFrame, model: Boosting | Forest, features: Sequence[str] = MODEL_FEATURES, fit_on: Sequence[str] = ("train",), keys: Sequence[str] = KEYS, target: str = TARGET
) -> DataFrame:
    """Share of each feature in the gain of a series' own model: keys, Feature, Importance. All 0 where nothing was split."""
    keys, features, types = list(keys), list(features), dict(parts.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_date")
        _, _, gains = _fitted(group, features, model, fit_on, np.zeros((0, len(features))))
        total = gains.sum()
        share = gains / total if total > 0 else gains
        first = {f"_key_{i}": group[f"_key_{i}"].iloc[0] for i in range(len(keys))}
        return pd.DataFrame({**{k: [v] * len(features) for k, v in first.items()}, "Feature": features, "Importance": share})

    used = [*fit_on, "val"] if getattr(model, "early_stop", False) else list(fit_on)
    schema = ", ".join([f"_key_{i} {types[k]}" for i, k in enumerate(keys)] + ["Feature string", "Importance double"])
    found = _prepared(parts, features, keys, target, used).groupBy(*[f"_key_{i}" for i in range(len(keys))]).applyInPandas(run, schema)
    return found.select(*[F.col(f"_key_{i}").alias(k) for i, k in enumerate(keys)], "Feature", "Importance")
