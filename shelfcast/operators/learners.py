"""Global tree models on Spark ML: one distributed fit over all series, with store and department as features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalars import at_most, ratio
from shelfcast.names import DATE, HOLIDAY, KEYS, TARGET
from shelfcast.operators import binned_trees
from shelfcast.operators.baselines import PREDICTION_COLUMNS, naive_columns
from shelfcast.operators.evaluate import error_metrics
from shelfcast.session import cut_lineage

MODEL_FEATURES = ("Store", "Dept", "Temperature", "Fuel_Price", "CPI", "Unemployment", HOLIDAY, "Size")
UPLIFT_FEATURES = (
    HOLIDAY, "Fuel_Price", "CPI", "Unemployment", "Temperature", "Store", "Dept", "Size",
    "Lag_1", "Lag_4", "Rolling_Mean_4", "Fuel_Holiday", "CPI_Holiday", "Type_B", "Type_C",
)


@dataclass(frozen=True)
class Boosting:
    """Settings of a boosted-trees model; ``early_stop`` needs rows labelled as the "val" part.

    With early stopping, trees are added until the validation error has not improved for ``patience`` trees, and the
    trees after the best one are dropped.
    """

    trees: int = 100
    depth: int = 5
    rate: float = 0.1
    row_share: float = 1.0
    feature_share: float = 1.0
    early_stop: bool = False
    patience: int = 20
    seed: int = 42


# The model settings in use.
BASIC = Boosting(100, 5, 0.1)
TUNED = Boosting(200, 7, 0.05, 0.8, 0.8)
HYBRID = Boosting(150, 5, 0.1)
PLAIN_RATE = Boosting(100, 5, 0.3)
EARLY_STOPPED = Boosting(200, 6, 0.05, 0.8, 0.8, early_stop=True)
WHAT_IF = Boosting(500, 6, 0.05, 0.8, 0.8)


@dataclass(frozen=True)
class Forest:
    trees: int = 100
    depth: int = 10
    min_leaf: int = 1
    seed: int = 42


GLOBAL_FOREST = Forest(50, 10)
SERIES_FOREST = Forest(100, 10)


def numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles with missing values set to 0, as the models expect."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


#: Rows of a training partition, about: a fit runs a job per tree level, so small tables go in few tasks.
FIT_PARTITION_ROWS = 50_000


def training_rows(train: DataFrame, features: Sequence[str], target: str, extra: Sequence[str] = (), written: bool = False) -> DataFrame:
    """A written copy of just the needed columns, in partitions that follow the number of rows.

    ``written`` says that ``train`` is a selection from a written table already.
    """
    needed = numeric(train, features).where(F.col(target).isNotNull())
    rows = needed.select(*features, F.col(target).cast("double").alias(target), *extra)
    rows = rows if written else cut_lineage(rows)
    return rows.coalesce(max(1, rows.count() // FIT_PARTITION_ROWS))


def bins_for(rows: DataFrame, features: Sequence[str], least: int = 32, keys: Sequence[str] = KEYS) -> int:
    """Split candidates per feature: enough to keep every store and department apart where they are features."""
    found = [k for k in keys if k in features]
    counts = rows.agg(*[F.count_distinct(k).alias(k) for k in found]).first() if found else []
    return max([least, *(n + 1 for n in counts)])


def _fit(train: DataFrame, features: Sequence[str], target: str, estimator, written: bool = False) -> PipelineModel:
    rows = training_rows(train, features, target, written=written)
    estimator = estimator.setMaxBins(bins_for(rows, features))
    return Pipeline(stages=[_assembler(features), estimator]).fit(rows)


def best_prefix(errors: Sequence[float], patience: int) -> int:
    """Trees to keep, given the validation error after each: the best before ``patience`` trees without improvement."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def fit_boosting(
    train: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    settings: Boosting = BASIC,
    target: str = TARGET,
    written: bool = False,
) -> PipelineModel:
    """Gradient boosted trees over all series. With early stopping the "val" rows of ``train`` judge each added tree.

    The trees of a shorter fit are the first ones of a longer fit, so the model is fitted in full, its prefixes are
    scored on the validation rows in one pass, and the best prefix is fitted again.
    """
    def boosting(trees: int) -> GBTRegressor:
        return GBTRegressor(
            featuresCol="features",
            labelCol=target,
            predictionCol="Predicted",
            maxIter=trees,
            maxDepth=settings.depth,
            stepSize=settings.rate,
            subsamplingRate=settings.row_share,
            featureSubsetStrategy="all" if settings.feature_share >= 1 else str(settings.feature_share),
            seed=settings.seed,
        )

    if not settings.early_stop:
        return _fit(train, features, target, boosting(settings.trees), written)
    rows = training_rows(train, features, target, ["split"], written)
    fit_rows, val = rows.where("split <> 'val'").drop("split"), rows.where("split = 'val'").drop("split")
    bins = bins_for(rows, features)
    whole = Pipeline(stages=[_assembler(features), boosting(settings.trees).setMaxBins(bins)]).fit(fit_rows)
    errors = whole.stages[-1].evaluateEachIteration(whole.stages[0].transform(val), "squared")
    keep = best_prefix(errors, settings.patience)
    if keep == settings.trees:
        return whole
    return Pipeline(stages=[_assembler(features), boosting(keep).setMaxBins(bins)]).fit(fit_rows)


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    settings: Forest = SERIES_FOREST,
    target: str = TARGET,
    written: bool = False,
) -> PipelineModel:
    """Random forest over all series; every split tries all features."""
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol="Predicted",
        numTrees=settings.trees,
        maxDepth=settings.depth,
        minInstancesPerNode=settings.min_leaf,
        featureSubsetStrategy="all",
        seed=settings.seed,
    )
    return _fit(train, features, target, forest, written)


def fit_second_order(
    train: DataFrame, features: Sequence[str], settings: Boosting, target: str = TARGET, row_id: Sequence[str] = (*KEYS, DATE)
) -> binned_trees.TreeModel:
    """Boosted trees over all rows from gradients and curvatures, with ridge leaves; a job per level, whatever the rows."""
    rows = train.where(F.col(target).isNotNull()).withColumn("_all", F.lit(1.0))
    blocks = binned_trees.blocks_of(rows, features, {"y": target, "all": "_all"}, row_id)
    return binned_trees.boosted(
        blocks, [binned_trees.Task("y", "all")], settings.trees, settings.depth, settings.rate, settings.row_share, settings.feature_share, settings.seed
    )[0]


def score(model: PipelineModel | binned_trees.TreeModel, rows: DataFrame, features: Sequence[str] = MODEL_FEATURES, out: str = "Predicted") -> DataFrame:
    """Rows with the model's prediction; columns that served as features come back unfilled."""
    if isinstance(model, binned_trees.TreeModel):
        return binned_trees.scored(model, rows, out)
    packed = rows.withColumn("_row", F.struct(*rows.columns))
    scored = model.transform(numeric(packed, features).drop("Predicted"))
    return scored.select("_row.*", F.col("Predicted").alias(out))


def predictions(model: PipelineModel, rows: DataFrame, name: str, features: Sequence[str] = MODEL_FEATURES, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """Scored rows in the long prediction form."""
    return score(model, rows, features).select(
        *keys, DATE, F.col(target).alias("Actual"), "Predicted", F.lit(name).alias("Model")
    )


def average_of(
    models: Sequence[PipelineModel], rows: DataFrame, name: str = "Ensemble", features: Sequence[str] = MODEL_FEATURES, keys: Sequence[str] = KEYS, target: str = TARGET
) -> DataFrame:
    """Unweighted mean of several models' predictions, scored in one pass over the rows."""
    scored = rows
    for i, m in enumerate(models):
        scored = score(m, scored, features, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(1, len(models))), F.col("_p0")) / len(models)
    return scored.select(*keys, DATE, F.col(target).alias("Actual"), mean.alias("Predicted"), F.lit(name).alias("Model"))


def scenario_scores(model: PipelineModel, scenarios: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Predictions for user-given factor values, many scenarios at once."""
    return score(model, scenarios, features)


def hybrid_wide(
    split_df: DataFrame,
    scored: DataFrame,
    profile: DataFrame,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    max_val_mape: float = 50.0,
) -> DataFrame:
    """Test rows with naive, learned and finally chosen prediction.

    ``scored`` holds the learned model's predictions for the "val" and "test" rows. The learned model
    is allowed for a series only when its validation MAPE stays under the limit. The recommendation
    decides; an ensemble weighs the naive model by the volatility of the training part (at most 0.9).
    """
    val = scored.where(F.col("split") == "val").select(*keys, F.col(target).alias("Actual"), "Predicted")
    gate = error_metrics(val, keys).select(
        *keys, F.coalesce((F.col("Avg_Sales") > 0) & (F.col("MAPE") < max_val_mape), F.lit(False)).alias("_allowed")
    )
    spread = (
        split_df.where(F.col("split") == "train")
        .groupBy(*keys)
        .agg(ratio(F.stddev_samp(target), F.avg(target)).alias("_cv"))
        .select(*keys, at_most("_cv", 0.9).alias("Naive_Weight"))
    )
    info = profile.select(*keys, "Recommended", "DataPoints").join(gate, list(keys), "left").join(spread, list(keys), "left")
    naive = naive_columns(split_df, keys, target).select(*keys, DATE, F.col(target).alias("Actual"), "Naive")
    learned = scored.where(F.col("split") == "test").select(*keys, DATE, F.col("Predicted").alias("_learned"))

    allowed = F.coalesce("_allowed", F.lit(False))
    recommended = F.col("Recommended")
    use = (
        F.when((recommended == "NAIVE") | ~allowed, "NAIVE")
        .when(recommended == "XGBOOST", "XGBOOST")
        .when(recommended == "ENSEMBLE", "ENSEMBLE")
        .otherwise("NAIVE (Fallback)")
    )
    weight = F.col("Naive_Weight")
    chosen = (
        F.when(F.col("Model_Used") == "XGBOOST", F.col("XGBoost"))
        .when(F.col("Model_Used") == "ENSEMBLE", weight * F.col("Naive") + (1 - weight) * F.col("XGBoost"))
        .otherwise(F.col("Naive"))
    )
    return (
        naive.join(learned, [*keys, DATE], "left")
        .join(info, list(keys))
        .withColumn("XGBoost", F.when(allowed, F.col("_learned")))
        .withColumn("Model_Used", use)
        .withColumn("Naive_Weight", F.when(F.col("Model_Used") == "ENSEMBLE", weight))
        .withColumn("Predicted", chosen)
        .drop("_learned", "_allowed")
    )


def hybrid_predictions(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return wide.select(*keys, DATE, "Actual", "Predicted", F.col("Model_Used").alias("Model"))


def hybrid_results(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per series: the errors of the naive, the learned and the chosen forecast."""
    error = lambda c: F.avg(F.abs(F.col("Actual") - F.col(c)))
    agg = wide.groupBy(*keys, "Recommended", "Model_Used", "DataPoints").agg(
        F.max("Naive_Weight").alias("Naive_Weight"),
        error("Naive").alias("_naive"),
        error("XGBoost").alias("_learned"),
        error("Predicted").alias("Final_MAE"),
        F.avg("Actual").alias("_mean"),
    )
    mape = lambda c: ratio(c, "_mean") * 100
    return agg.select(
        *keys, "Recommended", "Model_Used", "Naive_Weight",
        mape("_naive").alias("Naive_MAPE"),
        mape("_learned").alias("XGBoost_MAPE"),
        mape("Final_MAE").alias("Final_MAPE"),
        "Final_MAE", "DataPoints",
    )
