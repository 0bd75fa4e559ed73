"""Tree models of every series as a table: fitted once, stored, and applied to later weeks by key.

A row holds one model of one series: the statistics of its scaler and its trees as node arrays. Scoring brings the rows of a
series and its models together by their key, so neither the models nor the rows of more than one series are ever held by a task.
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
from shelfcast.operators.learners import MODEL_FEATURES, Boosting, Forest, numeric
from shelfcast.operators.series_trees import Tree, _prepared, boost, forest
from shelfcast.sources import sinks

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a model row holds beside its keys. ``Nodes`` are the sizes of the trees, whose arrays follow one another; a child is
#: counted from the first node of its tree, a feature of -1 marks a leaf, and a prediction is ``Start`` plus one leaf per tree.
MODEL_COLUMNS = (
    "Model string, Trees int, Features array<string>, Means array<double>, Scales array<double>, Start double, "
    "Nodes array<int>, Feature array<int>, Threshold array<double>, Child array<int>, Value array<double>"
)


def scaler_of(x: np.ndarray, scale: bool) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) by column; a constant column is centred and not scaled. Zeros and ones without ``scale``."""
    if not scale or not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1])
    deviation = np.where(x.min(axis=0) < x.max(axis=0), x.std(axis=0), 0.0)
    return x.mean(axis=0), np.where(deviation > 0, deviation, 1.0)


def score_trees(x: np.ndarray, start: float, nodes: np.ndarray, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Start plus the leaves of all trees, added in their order; all rows walk all trees one level at a time."""
    first = np.cumsum(nodes) - nodes
    node = np.tile(first, (len(x), 1))
    rows = np.arange(len(x))[:, None]
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            break
        right = x[rows, np.maximum(feature[node], 0)] > threshold[node]
        node = np.where(inner, first + child[node] + right, node)
    # A running sum adds from left to right, as the fit did, so the scores are the same to the last bit.
    return np.cumsum(np.column_stack([np.full(len(x), start), value[node]]), axis=1)[:, -1]


def fit_series_models(
    parts: DataFrame,
    models: Mapping[str, Boosting | Forest],
    features: Sequence[str] = MODEL_FEATURES,
    fit_on: Sequence[str] = ("train",),
    scale: bool = False,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
) -> DataFrame:
    """One row per series and model: the keys and ``MODEL_COLUMNS``.

    Early stopping watches the "val" part, which must not be fitted on then. With ``scale`` the features are standardised by
    the statistics of the fitted rows of the series. A series without rows to fit on has no model.
    """
    if "val" in fit_on and any(isinstance(m, Boosting) and m.early_stop for m in models.values()):
        raise ValueError("early stopping watches the validation part, so no model may be fitted on it")
    keys, features, fit_on, types = list(keys), list(features), list(fit_on), dict(parts.dtypes)
    ids = [f"_key_{i}" for i in range(len(keys))]
    watched = any(getattr(m, "early_stop", False) for m in models.values())
    schema = ", ".join([f"{i} {types[k]}" for i, k in zip(ids, keys, strict=True)] + [MODEL_COLUMNS])
    names = [*ids, *(c.split()[0] for c in MODEL_COLUMNS.split(", "))]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_date")
        here = group["_split"].isin(fit_on).to_numpy()
        if not here.any():
            return pd.DataFrame(columns=names)
        x, y = group[features].to_numpy(float), group["_y"].to_numpy(float)
        means, scales = scaler_of(x[here], scale)
        x = (x - means) / scales
        val = (group["_split"] == "val").to_numpy() & ~here
        rows = []
        for name, model in models.items():
            grown: list[Tree] = []
            if isinstance(model, Forest):
                forest(x[here], y[here], model, [], grown)
                start = 0.0
            else:
                boost(x[here], y[here], model, (x[val], y[val]), [], grown)
                start = float(y[here].mean())
            join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(t[k] for t in grown)]).astype(kind)
            rows.append((
                *(group[i].iloc[0] for i in ids), name, len(grown), features, means, scales, start, np.array([len(t[0]) for t in grown], np.int32),
                join(0, np.int32), join(1, float), join(2, np.int32), join(3, float),
            ))
        return pd.DataFrame(rows, columns=names)

    used = sorted({*fit_on, *(["val"] if watched else [])})
    fitted = _prepared(parts, features, keys, target, used).groupBy(*ids).applyInPandas(run, schema)
    return fitted.select(*[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], *names[len(ids):])


def save_series_models(models: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """Parquet, in the order of the keys within each file, so that reading a few series skips most row groups."""
    sinks.write_table(models.sortWithinPartitions(*keys, "Model"), path)


def score_series(rows: DataFrame, models: DataFrame, features: Sequence[str] = MODEL_FEATURES, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Every row under every stored model of its series: keys, Date, Model, Predicted.

    Rows need no sales, so weeks to come can be scored. ``features`` must hold all features of the stored models; missing
    values count as 0, as in the fit. Rows of a series without a stored model have a NULL model and prediction; rows without a
    key belong to no series and are scored only by a model stored without one.
    """
    keys, features, types = list(keys), list(features), dict(rows.dtypes)
    ids = [f"_key_{i}" for i in range(len(keys))]
    aliased = lambda df: [F.col(k).cast(types[k]).alias(i) for i, k in zip(ids, keys, strict=True)]
    given = numeric(rows.select(*aliased(rows), F.col(date).alias("_date"), *features), features)
    stored = models.select(*aliased(models), *[c.split()[0] for c in MODEL_COLUMNS.split(", ")])

    def run(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        blocks, base = [], group[[*ids, "_date"]]
        for m in known.sort_values("Model").itertuples(index=False):
            x = (group[list(m.Features)].to_numpy(float) - np.asarray(m.Means)) / np.asarray(m.Scales)
            whole = [np.asarray(a, np.int64) for a in (m.Nodes, m.Feature, m.Child)]
            found = score_trees(x, m.Start, whole[0], whole[1], np.asarray(m.Threshold, float), whole[2], np.asarray(m.Value, float))
            blocks.append(base.assign(Model=m.Model, Predicted=found))
        return pd.concat(blocks) if blocks else base.assign(Model=None, Predicted=None)

    schema = ", ".join([f"{i} {types[k]}" for i, k in zip(ids, keys, strict=True)] + ["_date date", "Model string", "Predicted double"])
    scored = given.groupBy(*ids).cogroup(stored.groupBy(*ids)).applyInPandas(run, schema)
    return scored.select(*[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], F.col("_date").alias(date), "Model", "Predicted")
