"""Holiday uplift: a causal estimate per row, its average with an interval, rollups, and the what-if contrast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.quantiles import attach_scalars
from shelfcast.names import DATE, HOLIDAY, KEYS, TARGET
from shelfcast.operators import binned_trees, causal_forest
from shelfcast.operators.combine import key_digest, one_hot
from shelfcast.operators.features import uplift_features
from shelfcast.operators.learners import UPLIFT_FEATURES, Boosting, Forest, score
from shelfcast.session import cut_lineage

# Controls of the causal model and its settings.
CONTROLS = ("Fuel_Price", "CPI", "Unemployment", "Temperature", "Lag_1", "Lag_4", "Month", "Week", "Size")
NUISANCE = Boosting(200, 6, 0.05, 0.8, 0.8)
CAUSAL_FOREST = Forest(500, 12, 50)


def uplift_rows(fact: DataFrame, needed: Sequence[str] = CONTROLS) -> DataFrame:
    """Fact rows with lags and calendar columns, complete in the columns a model uses."""
    return uplift_features(fact).dropna(subset=[*needed, TARGET])


def cross_fit_residuals(
    rows: DataFrame,
    controls: Sequence[str] = CONTROLS,
    folds: int = 2,
    settings: Boosting = NUISANCE,
    treatment: str = HOLIDAY,
    target: str = TARGET,
    row_id: Sequence[str] = (*KEYS, DATE),
    clip: float = 0.01,
) -> DataFrame:
    """Outcome and treatment residuals; each fold is predicted by models that never saw it.

    The outcome and treatment models of all folds grow in step: every job splits a level of one tree of each.
    """
    fold = F.conv(F.substring(key_digest(row_id), 1, 8), 16, 10).cast("bigint") % folds
    table = cut_lineage(rows.withColumn("_fold", fold).withColumn("_t", F.col(treatment).cast("double")))
    learns = {f"learns_{k}": f"_learns_{k}" for k in range(folds)}
    marked = table.where(F.col(target).isNotNull()).withColumns({f"_learns_{k}": (F.col("_fold") != k).cast("double") for k in range(folds)})
    blocks = binned_trees.blocks_of(marked, controls, {"y": target, "t": "_t"} | learns, row_id)
    tasks = [binned_trees.Task("y", k) for k in learns] + [binned_trees.Task("t", k, logistic=True) for k in learns]
    models = binned_trees.boosted(blocks, tasks, settings.trees, settings.depth, settings.rate, settings.row_share, settings.feature_share, settings.seed)
    names = [f"_{what}_{k}" for what in ("y_hat", "p") for k in range(folds)]
    scored = binned_trees.with_arrays(table, controls, lambda x: [m.predict(x) for m in models], names)
    of_fold = lambda what: F.coalesce(*[F.when(F.col("_fold") == k, F.col(f"_{what}_{k}")) for k in range(folds)])
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), of_fold("p")))
    return scored.withColumns({"_y_res": F.col(target) - of_fold("y_hat"), "_t_res": F.col("_t") - p}).drop("_fold", *names)


def causal_uplift(
    residuals: DataFrame,
    controls: Sequence[str] = CONTROLS,
    settings: Forest = CAUSAL_FOREST,
    cluster: Sequence[str] = KEYS[:1],
    row_id: Sequence[str] = (*KEYS, DATE),
) -> tuple[DataFrame, causal_forest.CausalForest]:
    """Effect of the treatment per row with its standard error and interval, by an honest causal forest; and the forest."""
    known = residuals.where(F.col("_y_res").isNotNull())
    model = causal_forest.fit(known, controls, "_y_res", "_t_res", cluster, row_id, settings.trees, settings.depth, settings.min_leaf, seed=settings.seed)
    return causal_forest.with_effects(model, residuals.drop("_t", "_y_res", "_t_res")), model


def mean_interval(effects: DataFrame, measure: str = "Holiday_Uplift") -> DataFrame:
    """The mean effect and the means of the rows' bounds."""
    return effects.agg(F.avg(measure).alias("Effect"), F.avg("Lower").alias("Lower"), F.avg("Upper").alias("Upper"), F.count(measure).alias("Rows"))


def average_effect(residuals: DataFrame, cluster: str | None = None, z: float = 1.96) -> DataFrame:
    """Average effect with a 95% interval; errors may be correlated inside ``cluster``."""
    y, t = F.col("_y_res"), F.col("_t_res")
    slope = residuals.agg((F.sum(y * t) / F.sum(t * t)).alias("Effect"), F.sum(t * t).alias("_info"), F.count(F.lit(1)).alias("Rows"))
    scores = attach_scalars(residuals, slope.select("Effect")).withColumn("_score", t * (y - F.col("Effect") * t))
    if cluster:
        scores = scores.groupBy(cluster).agg(F.sum("_score").alias("_score"))
    meat = scores.agg(F.sum(F.col("_score") * F.col("_score")).alias("_meat"))
    se = F.sqrt("_meat") / F.col("_info")
    return attach_scalars(slope, meat).select(
        "Effect", se.alias("Std_Error"), (F.col("Effect") - z * se).alias("Lower"), (F.col("Effect") + z * se).alias("Upper"), "Rows"
    )


def uplift_rollups(effects: DataFrame, measure: str = "Holiday_Uplift", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean uplift per series, store, department and overall, in one grouping-sets aggregation."""
    sets = [list(keys), *[[k] for k in keys], []]
    level = F.when(F.grouping_id() == 0, "Series")
    for k in keys:
        others = [o for o in keys if o != k]
        level = level.when((F.grouping(k) == 0) & reduce(lambda a, b: a & b, [F.grouping(o) == 1 for o in others]), k)
    return effects.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.avg(measure).alias(measure), F.count(measure).alias("Rows"), level.otherwise("All").alias("Level")
    )


def what_if_rows(fact: DataFrame, features: Sequence[str] = UPLIFT_FEATURES) -> DataFrame:
    """Rows for the what-if model: store type as 0/1 columns, complete in what is used."""
    rows = one_hot(uplift_features(fact), "Type", ["A", "B", "C"], drop_first=True)
    return rows.dropna(subset=[*features, TARGET])


def what_if_uplift(model: PipelineModel | binned_trees.TreeModel, rows: DataFrame, features: Sequence[str] = UPLIFT_FEATURES, flag: str = HOLIDAY) -> DataFrame:
    """Predicted sales with the holiday flag set minus without, everything else equal."""
    with_flag = score(model, rows.withColumn("_kept", F.col(flag)).withColumn(flag, F.lit(1)), features, "With_Holiday")
    without = score(model, with_flag.withColumn(flag, F.lit(0)), features, "Without_Holiday")
    return without.withColumn(flag, F.col("_kept")).drop("_kept").withColumn(
        "Holiday_Uplift", F.col("With_Holiday") - F.col("Without_Holiday")
    )
