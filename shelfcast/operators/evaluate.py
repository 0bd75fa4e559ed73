"""Error metrics, league tables and comparisons between models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.quantiles import attach_scalars
from shelfcast.functions.scalars import correlation, ratio, round_half_even
from shelfcast.names import KEYS
from shelfcast.operators.combine import best_per_group, model_rank
from shelfcast.operators.features import group_min


def error_metrics(predictions: DataFrame, by: Sequence[str] = (*KEYS, "Model")) -> DataFrame:
    """MAE, RMSE and MAPE per group, where MAPE is 100 * MAE / mean actual."""
    e = F.col("Actual") - F.col("Predicted")
    scored = predictions.where(e.isNotNull())
    agg = (scored.groupBy(*by) if by else scored).agg(
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg("Actual").alias("Avg_Sales"),
        F.count(F.lit(1)).alias("Weeks"),
    )
    return agg.withColumn("MAPE", ratio("MAE", "Avg_Sales") * 100)


def regression_quality(predictions: DataFrame, by: Sequence[str] = (), eps: float = 2.220446049250313e-16) -> DataFrame:
    """MAE, the true mean absolute percentage error (a fraction) and R squared."""
    e = F.col("Actual") - F.col("Predicted")
    scored = predictions.where(e.isNotNull())
    agg = (scored.groupBy(*by) if by else scored).agg(
        F.avg(F.abs(e)).alias("MAE"),
        F.avg(F.abs(e) / F.greatest(F.abs("Actual"), F.lit(eps))).alias("MAPE_True"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop("Actual") * F.count("Actual")).alias("_sst"),
    )
    return agg.withColumn("R2", 1 - ratio("_sse", "_sst")).drop("_sse", "_sst")


def league_table(predictions: DataFrame, stores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (series, model) with store type and the mean of the evaluated weeks."""
    metrics = error_metrics(predictions, (*keys, "Model"))
    types = stores.select("Store", F.col("Type").alias("Store_Type"))
    return metrics.join(types, "Store", "left").select(
        *keys, "Store_Type", "Model", "MAE", "RMSE", "MAPE", "Avg_Sales"
    )


def best_models(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The row with the smallest MAPE of each series; equal errors go by model order."""
    return best_per_group(results, "MAPE", keys)


def win_counts(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How often each model is best, and its share."""
    counts = best_models(results, keys).groupBy("Model").agg(F.count(F.lit(1)).alias("Count"))
    total = counts.agg(F.sum("Count").alias("_total"))
    return attach_scalars(counts, total).select(
        "Model", "Count", (F.col("Count") * 100 / F.col("_total")).alias("Percentage")
    )


def naive_vs_best(results: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = 1.05) -> DataFrame:
    """Naive error beside the best one, whether it is close, and the improvement still needed in percent."""
    naive = results.where(F.col("Model") == "Naive").select(*keys, F.col("MAPE").alias("Naive_MAPE"))
    best = best_models(results, keys).select(*keys, F.col("Model").alias("Best_Model"), F.col("MAPE").alias("Best_MAPE"))
    return naive.join(best, list(keys)).withColumns({
        "Naive_Wins": F.col("Naive_MAPE") <= F.col("Best_MAPE") * tolerance,
        "Improvement_Needed": ratio(F.col("Naive_MAPE") - F.col("Best_MAPE"), "Best_MAPE") * 100,
    })


def naive_close_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count_if("Naive_Wins").alias("Naive_Wins"),
        F.count(F.lit(1)).alias("Series"),
        (F.count_if("Naive_Wins") * 100 / F.count(F.lit(1))).alias("Win_Rate"),
        F.avg("Improvement_Needed").alias("Avg_Improvement_Needed"),
    )


def naive_wins_by_min(results: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = 1.05) -> DataFrame:
    """Number of naive rows within the tolerance of their series' smallest error."""
    return group_min(results, "MAPE", "_best", keys).agg(
        F.count_if((F.col("Model") == "Naive") & (F.col("MAPE") <= F.col("_best") * tolerance)).alias("Naive_Wins")
    )


def improvement_over_naive(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Improvement of every other model row over the naive row of its series, in percent."""
    naive = results.where(F.col("Model") == "Naive").select(*keys, F.col("MAPE").alias("_naive"))
    return (
        results.where(F.col("Model") != "Naive")
        .join(naive, list(keys))
        .withColumn("Improvement", ratio(F.col("_naive") - F.col("MAPE"), "_naive") * 100)
        .drop("_naive")
    )


def hybrid_comparison(hybrid: DataFrame, results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The hybrid against the best individual model and the naive one, per series."""
    best = best_models(results, keys).select(
        *keys, F.col("MAPE").alias("Best_Individual_MAPE"), F.col("Model").alias("Best_Individual_Model")
    )
    naive = results.where(F.col("Model") == "Naive").select(*keys, F.col("MAPE").alias("Naive_MAPE"))
    final = F.col("Hybrid_MAPE")
    return (
        hybrid.select(*keys, F.col("Model_Used").alias("Hybrid_Model"), F.col("Final_MAPE").alias("Hybrid_MAPE"))
        .join(best, list(keys))
        .join(naive, list(keys), "left")
        .withColumns({
            "Improvement_vs_Best": ratio(F.col("Best_Individual_MAPE") - final, "Best_Individual_MAPE") * 100,
            "Improvement_vs_Naive": ratio(F.col("Naive_MAPE") - final, "Naive_MAPE") * 100,
        })
    )


def accuracy_vs_character(results: DataFrame, profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Naive error beside the profile of the series and its sales volume."""
    naive = results.where(F.col("Model") == "Naive").select(*keys, "MAPE", "Avg_Sales")
    return naive.join(profile.select(*keys, "HolidayLift%", "SeasonalRatio", "CV", "Recommended"), list(keys))


def accuracy_correlations(table: DataFrame) -> DataFrame:
    return table.agg(
        correlation("MAPE", "HolidayLift%").alias("Corr_Lift"),
        correlation("MAPE", "CV").alias("Corr_CV"),
        correlation("MAPE", "Avg_Sales").alias("Corr_Volume"),
    )


def headline_kpis(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean naive error, the best and worst naive series, mean best error and the gap."""
    rest = F.struct(*keys, "MAPE")
    order = F.struct("MAPE", *keys)
    worst_order = F.struct("MAPE", *[-F.col(k) for k in keys])
    naive = results.where((F.col("Model") == "Naive") & F.col("MAPE").isNotNull()).agg(
        F.avg("MAPE").alias("Avg_MAPE"),
        F.min_by(rest, order).alias("_b"),
        F.max_by(rest, worst_order).alias("_w"),
    )
    best = best_models(results, keys).agg(F.avg("MAPE").alias("Best_Avg_MAPE"))
    return attach_scalars(naive, best).select(
        "Avg_MAPE",
        *[F.col("_b")[c].alias(f"Best_{c}") for c in (*keys, "MAPE")],
        *[F.col("_w")[c].alias(f"Worst_{c}") for c in (*keys, "MAPE")],
        "Best_Avg_MAPE",
        (F.col("Avg_MAPE") - F.col("Best_Avg_MAPE")).alias("Potential_Improvement"),
    )


def model_summary(results: DataFrame, digits: int | None = 2) -> DataFrame:
    """Mean, spread, best and worst error per model."""
    table = results.groupBy("Model").agg(
        F.avg("MAPE").alias("Mean_MAPE"),
        F.stddev_samp("MAPE").alias("Std_Dev"),
        F.min("MAPE").alias("Best"),
        F.max("MAPE").alias("Worst"),
    )
    if digits is None:
        return table
    return table.withColumns({c: round_half_even(c, digits) for c in ("Mean_MAPE", "Std_Dev", "Best", "Worst")})


def by_store_type(results: DataFrame) -> DataFrame:
    return results.groupBy("Store_Type").agg(
        F.avg("MAPE").alias("Mean_MAPE"), F.stddev_samp("MAPE").alias("Std_MAPE"), F.count(F.lit(1)).alias("Rows")
    )


def ranked_league(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """League table in order of error inside each series."""
    return results.orderBy(*keys, "MAPE", model_rank())
