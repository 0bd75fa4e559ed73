"""What forecast errors cost: lost sales, stock held too long, and what better models would save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalars import clip
from shelfcast.names import KEYS, TARGET
from shelfcast.operators.combine import drop_listed, keep_listed, measures_side_by_side
from shelfcast.operators.evaluate import best_models

WEEKS_PER_YEAR = 52


def _with_annual_sales(df: DataFrame, sales: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    means = sales.groupBy(*keys).agg(F.avg(target).alias("Avg_Weekly_Sales"))
    return df.join(means, list(keys)).withColumn("Annual_Sales", F.col("Avg_Weekly_Sales") * WEEKS_PER_YEAR)


def inventory_impact(
    results: DataFrame,
    sales: DataFrame,
    profile: DataFrame,
    profit_margin: float = 0.25,
    holding_cost: float = 0.25,
    stockout_penalty: float = 2.0,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    model: str = "Naive",
) -> DataFrame:
    """Yearly cost of the forecast error per series, split into stockouts and holding.

    Volatile series run short more often: the under-forecast share grows with CV, from 30% to 70%.
    A series without profile counts as CV 0.5.
    """
    rows = _with_annual_sales(results.where(F.col("Model") == model), sales, keys, target)
    rows = rows.join(profile.select(*keys, "CV"), list(keys), "left").withColumn("CV", F.coalesce("CV", F.lit(0.5)))
    under = F.col("Under_Forecast_Pct")
    return (
        rows.withColumn("Error_Dollars", F.col("MAPE") / 100 * F.col("Annual_Sales"))
        .withColumn("Under_Forecast_Pct", clip(0.3 + F.col("CV") * 0.4, 0.3, 0.7))
        .withColumn("Stockout_Cost", F.col("Error_Dollars") * under * profit_margin * stockout_penalty)
        .withColumn("Holding_Cost", F.col("Error_Dollars") * (1 - under) * holding_cost)
        .withColumn("Total_Impact", F.col("Stockout_Cost") + F.col("Holding_Cost"))
    )


def impact_totals(impact: DataFrame) -> DataFrame:
    return impact.agg(*[
        F.sum(c).alias(c) for c in ("Total_Impact", "Stockout_Cost", "Holding_Cost", "Error_Dollars")
    ])


# Volatility classes, open on the left and closed on the right.
VOLATILITY_BINS = (("Low", 0.0, 0.3), ("Medium", 0.3, 0.6), ("High", 0.6, 1.0), ("Very High", 1.0, float("inf")))


def impact_by_volatility(impact: DataFrame) -> DataFrame:
    """Impact and number of series per volatility class; classes without series stay, with 0."""
    spark = impact.sparkSession
    names = spark.createDataFrame(
        [(i, name) for i, (name, _, _) in enumerate(VOLATILITY_BINS)], "Bin_Order int, Volatility string"
    )
    label = F.lit(None).cast("string")
    for name, low, high in reversed(VOLATILITY_BINS):
        label = F.when((F.col("CV") > low) & (F.col("CV") <= high), name).otherwise(label)
    sums = impact.withColumn("Volatility", label).groupBy("Volatility").agg(
        F.sum("Total_Impact").alias("Total_Impact"), F.count(F.lit(1)).alias("Dept_Count")
    )
    return names.join(sums, "Volatility", "left").select(
        "Bin_Order",
        "Volatility",
        F.coalesce("Total_Impact", F.lit(0.0)).alias("Total_Impact"),
        F.coalesce("Dept_Count", F.lit(0)).cast("bigint").alias("Dept_Count"),
    )


def improvement_potential(
    results: DataFrame, sales: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET
) -> DataFrame:
    """Yearly error of the naive forecast minus that of the best model, per series."""
    naive = results.where(F.col("Model") == "Naive").select(*keys, "MAPE")
    best = best_models(results, keys).select(*keys, "MAPE")
    both = measures_side_by_side(naive, best, ["MAPE"], ("_Naive", "_Best"), keys)
    rows = _with_annual_sales(both, sales, keys, target)
    return (
        rows.withColumn("Current_Error", F.col("MAPE_Naive") / 100 * F.col("Annual_Sales"))
        .withColumn("Best_Error", F.col("MAPE_Best") / 100 * F.col("Annual_Sales"))
        .withColumn("Potential_Savings", F.col("Current_Error") - F.col("Best_Error"))
    )


def impact_contrast(impact: DataFrame, levels: DataFrame, keys: Sequence[str] = KEYS, pairwise: bool = True) -> DataFrame:
    """Mean cost of outlying and of normal series, and the difference."""
    odd = levels.where("Is_Outlier")
    outlying = keep_listed(impact, odd, keys, pairwise).select(F.lit(True).alias("_odd"), "Total_Impact")
    normal = drop_listed(impact, odd, keys, pairwise).select(F.lit(False).alias("_odd"), "Total_Impact")
    both = outlying.unionByName(normal).agg(
        F.avg(F.when(F.col("_odd"), F.col("Total_Impact"))).alias("Outlier_Avg"),
        F.avg(F.when(~F.col("_odd"), F.col("Total_Impact"))).alias("Normal_Avg"),
    )
    return both.withColumn("Difference", F.col("Outlier_Avg") - F.col("Normal_Avg"))
