"""Explanations of fitted models: global importance, importance per series, Shapley values per row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.quantiles import attach_scalars
from shelfcast.functions.scalars import correlation, ratio
from shelfcast.names import DATE, KEYS, TARGET
from shelfcast.operators.combine import key_digest, top_k_per_group
from shelfcast.operators.learners import MODEL_FEATURES, numeric, score


def model_importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """Importance of each feature inside a fitted tree model, largest first."""
    weights = model.stages[-1].featureImportances.toArray() if isinstance(model, PipelineModel) else model.importances()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return spark.createDataFrame(rows, "Feature string, Importance double").orderBy(F.desc("Importance"), "Feature")


def permutation_importance(
    model: PipelineModel,
    rows: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    seed: int = 42,
    constant: Sequence[str] = (*KEYS, "Size"),
) -> DataFrame:
    """How much the error of each series grows when one feature is shuffled inside it, as shares of the total.

    A shuffle hands each week the value of the next week in a random order of the series' weeks. A
    feature that is constant inside a series cannot matter there and gets 0; those in ``constant`` always are, and are
    not shuffled at all.
    """
    fixed = [f for f in features if f in constant]
    moving = [f for f in features if f not in constant]
    ids = [f"_key_{k}" for k in keys]
    known = rows.where(F.col(target).isNotNull()).withColumns(dict(zip(ids, [F.col(k) for k in keys])))
    shuffled = numeric(known, features).select(*ids, F.col(DATE).alias("_date"), F.col(target).alias("_y"), *features)
    for i, f in enumerate(moving):
        order = Window.partitionBy(*ids).orderBy(key_digest([*ids, "_date"], seed + i))
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        shuffled = shuffled.withColumn(f"_s_{f}", F.coalesce(F.lead(f).over(order), F.first(f).over(whole)))
    versions = [F.struct(F.lit("").alias("Feature"), *[F.col(f).alias(f) for f in features])]
    versions += [
        F.struct(F.lit(g).alias("Feature"), *[F.col(f"_s_{f}" if f == g else f).alias(f) for f in features])
        for g in moving
    ]
    long = shuffled.select(*ids, "_y", F.inline(F.array(*versions)))
    errors = (
        score(model, long, features)
        .groupBy(*ids, "Feature")
        .agg(F.avg(F.abs(F.col("_y") - F.col("Predicted"))).alias("_mae"))
    )
    whole_series = Window.partitionBy(*ids)
    plain = F.max(F.when(F.col("Feature") == "", F.col("_mae"))).over(whole_series)
    raised = errors.withColumn("_rise", F.greatest(F.col("_mae") - plain, F.lit(0.0)))
    share = ratio("_rise", F.sum("_rise").over(whole_series))
    # The row of the unshuffled version stands for the features that were not shuffled.
    named = F.when(F.col("Feature") == "", F.array(*[F.lit(f) for f in fixed]).cast("array<string>")).otherwise(F.array("Feature"))
    return (
        raised.withColumn("Importance", F.coalesce(share, F.lit(0.0)))
        .withColumn("Feature", F.explode(named))
        .select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], "Feature", "Importance")
    )


def with_store_type(importance: DataFrame, stores: DataFrame) -> DataFrame:
    types = stores.select("Store", F.col("Type").alias("Store_Type"))
    return importance.join(types, "Store", "left")


def correlation_importance(
    rows: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS, target: str = TARGET
) -> DataFrame:
    """A model-free importance: the absolute correlation of each feature with the target inside a series."""
    flat = rows.groupBy(*keys).agg(*[F.abs(correlation(f, target)).alias(f) for f in features])
    return flat.unpivot(list(keys), list(features), "Feature", "Importance").withColumn(
        "Importance", F.coalesce("Importance", F.lit(0.0))
    )


def mean_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """Mean importance per feature over all series, the k largest."""
    return importance.groupBy("Feature").agg(F.avg("Importance").alias("Importance")).orderBy(
        F.desc("Importance"), "Feature"
    ).limit(k)


def importance_summary(importance: DataFrame, top_n: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series: number of features, the leading one, and the share of the n leading ones in percent."""
    ranked = top_k_per_group(importance, keys, "Importance", top_n, ties=("Feature",))
    head = ranked.groupBy(*keys).agg(
        F.sum("Importance").alias("_top"),
        F.max(F.when(F.col("rank") == 1, F.col("Feature"))).alias("Top_Feature"),
        F.max("Importance").alias("Top_Importance"),
    )
    total = importance.groupBy(*keys).agg(F.count(F.lit(1)).alias("Features"), F.sum("Importance").alias("_all"))
    return head.join(total, list(keys)).select(
        *keys, "Features", "Top_Feature", "Top_Importance", (ratio("_top", "_all") * 100).alias("Top_Share")
    )


def shapley_values(
    model: PipelineModel,
    rows: DataFrame,
    features: Sequence[str],
    row_id: Sequence[str] = (*KEYS, DATE),
    pairs: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Shapley values per row against the mean row, by walking ``pairs`` random feature orders forth and back.

    Each order switches the features of the mean row to the row's own values one at a time; the step
    a feature makes is its contribution. The values of a row add up to its prediction minus the
    prediction of the mean row, exactly. The walked versions of a row are produced, scored and
    summed inside one partition before anything is shuffled.
    """
    rng = np.random.default_rng(seed)
    orders = []
    for _ in range(pairs):
        order = [int(i) for i in rng.permutation(len(features))]
        orders += [order, order[::-1]]

    ids = [f"_id_{c}" for c in row_id]
    base = numeric(rows.withColumns(dict(zip(ids, [F.col(c) for c in row_id]))), features).select(*ids, *features)
    means = base.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    walked = attach_scalars(base, means).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("_o"))
    walked = walked.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("_k"))
    # Step k of an order has switched the features whose place in the order is below k.
    place = [F.element_at(F.array(*[F.lit(order.index(i)) for order in orders]), F.col("_o") + 1) for i in range(len(features))]
    walked = walked.select(*ids, "_o", "_k", *[F.when(p < F.col("_k"), F.col(f)).otherwise(F.col(f"_m_{f}")).alias(f"_w_{f}") for p, f in zip(place, features)])

    assembler = VectorAssembler(inputCols=[f"_w_{f}" for f in features], outputCol="features")
    scored = model.stages[-1].transform(assembler.transform(walked))
    value = F.col("Predicted")

    def contribution(i: int):
        step = F.when(F.col("_k") == place[i] + 1, value).when(F.col("_k") == place[i], -value)
        return F.sum(step) / len(orders)

    shap = scored.groupBy(*ids).agg(
        *[contribution(i).alias(f"Shap_{f}") for i, f in enumerate(features)],
        F.max(F.when((F.col("_o") == 0) & (F.col("_k") == len(features)), value)).alias("Predicted"),
        F.max(F.when((F.col("_o") == 0) & (F.col("_k") == 0), value)).alias("Baseline"),
    )
    return shap.withColumnsRenamed(dict(zip(ids, row_id)))


def shapley_with_features(
    shap: DataFrame, rows: DataFrame, features: Sequence[str], row_id: Sequence[str] = (*KEYS, DATE)
) -> DataFrame:
    """Shapley values beside the feature values they explain, matched on the row id."""
    return shap.join(rows.select(*row_id, *[f for f in features if f not in row_id]), list(row_id))
