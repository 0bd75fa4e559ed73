"""Outlying series and weeks, their causes, and tests of the factors behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import holiday_season, month_name
from shelfcast.functions.quantiles import attach_scalars, box_outliers
from shelfcast.functions.scalars import mean_over, ratio, round_half_even
from shelfcast.functions.ttest import student_t_p
from shelfcast.names import DATE, FACTORS, HOLIDAY, KEYS, TARGET
from shelfcast.operators.combine import best_per_group, key_digest, optional_in
from shelfcast.operators.features import z_score


def series_levels(df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, digits: int = 2) -> DataFrame:
    """Mean, spread, extremes and number of weeks per series, rounded as published."""
    stats = df.groupBy(*keys).agg(
        F.avg(target).alias("Mean"),
        F.stddev_samp(target).alias("Std"),
        F.min(target).alias("Min"),
        F.max(target).alias("Max"),
        F.count(target).alias("Weeks"),
    )
    return stats.withColumns({c: round_half_even(c, digits) for c in ("Mean", "Std", "Min", "Max")})


def dept_outliers(
    df: DataFrame, profile: DataFrame | None = None, keys: Sequence[str] = KEYS, threshold: float = 2.0
) -> DataFrame:
    """Series whose (rounded) mean is far from the other series, with their profile figures."""
    levels = series_levels(df, keys)
    spread = levels.agg(F.avg("Mean").alias("_m"), F.stddev_samp("Mean").alias("_s"))
    scored = (
        attach_scalars(levels, spread)
        .withColumn("Z_Score", ratio(F.col("Mean") - F.col("_m"), F.col("_s")))
        .withColumn("Is_Outlier", F.coalesce(F.abs("Z_Score") > threshold, F.lit(False)))
        .drop("_m", "_s")
    )
    if profile is None:
        return scored
    return scored.join(profile.select(*keys, "CV", "HolidayLift%", "ZeroPct"), list(keys), "left")


def weekly_outliers(df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, threshold: float = 2.0) -> DataFrame:
    """Every week with its score inside the series and the outlier flag."""
    scored = z_score(df, {target: "Weekly_Z_Dept"}, keys)
    return scored.withColumn("Is_Weekly_Outlier", F.coalesce(F.abs("Weekly_Z_Dept") > threshold, F.lit(False)))


def outlier_rate(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if("Is_Weekly_Outlier").alias("Weekly_Outliers"),
        F.count(F.lit(1)).alias("Weeks"),
        (F.count_if("Is_Weekly_Outlier") * 100 / F.count(F.lit(1))).alias("Outlier_Rate"),
    )


def factor_scores(
    df: DataFrame, factors: Sequence[str] = FACTORS, store: str = "Store", few_stores: bool = False
) -> DataFrame:
    """Score of each economic factor inside its store."""
    return z_score(df, {f: f"{f}_Z" for f in factors}, (store,), few_stores)


def label_causes(scored: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Cause of each outlying week; the first rule that holds wins."""
    shock = lambda f: F.abs(f"{f}_Z") > threshold
    cause = F.when(F.col(HOLIDAY).cast("int") == 1, "Holiday-Driven")
    for factor in ("Fuel_Price", "CPI", "Unemployment"):
        cause = cause.when(shock(factor), f"{factor} Shock")
    cause = cause.when(holiday_season(DATE), "Seasonal Peak").when(shock("Temperature"), "Temperature Extreme")
    return (
        scored.where("Is_Weekly_Outlier")
        .withColumn("Month", F.month(DATE))
        .withColumn("Cause", cause.otherwise("Unknown"))
    )


def outlier_causes(df: DataFrame, keys: Sequence[str] = KEYS, few_stores: bool = False) -> DataFrame:
    """From the fact table straight to labelled outlier weeks. ``few_stores``: their number is known to be small."""
    return label_causes(factor_scores(weekly_outliers(df, keys), few_stores=few_stores))


def cause_distribution(
    labelled: DataFrame, stores: Sequence[int] | None = None, depts: Sequence[int] | None = None
) -> DataFrame:
    """Count and share per cause, for all outliers or the selected stores and departments."""
    counts = optional_in(labelled, Store=stores, Dept=depts).groupBy("Cause").agg(F.count(F.lit(1)).alias("Count"))
    total = counts.agg(F.sum("Count").alias("_total"))
    return attach_scalars(counts, total).select(
        "Cause", "Count", (F.col("Count") * 100 / F.col("_total")).alias("Percentage")
    )


def cause_by_month(
    labelled: DataFrame, stores: Sequence[int] | None = None, depts: Sequence[int] | None = None
) -> DataFrame:
    return (
        optional_in(labelled, Store=stores, Dept=depts)
        .groupBy("Month", "Cause")
        .agg(F.count(F.lit(1)).alias("Count"))
        .withColumn("Month_Name", month_name("Month"))
        .orderBy("Month", "Cause")
    )


def advice_for_causes(labelled: DataFrame, advice: DataFrame) -> DataFrame:
    """Advice lines for the causes that occur, with their number of outliers."""
    counts = labelled.groupBy("Cause").agg(F.count(F.lit(1)).alias("Count"))
    return counts.join(advice, "Cause").select("Cause", "Count", "seq", "advice")


def extreme_weeks(
    df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, q: float = 0.99, factor: float = 2.0
) -> DataFrame:
    """Weeks above a multiple of the series' own high quantile (buffer bounded by the series' weeks)."""
    high = df.groupBy(*keys).agg(F.percentile(target, q).alias("P99"))
    return df.join(high, list(keys)).where(F.col(target) > factor * F.col("P99"))


def iqr_outliers(df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET, whisker: float = 1.5) -> DataFrame:
    """Weeks outside the interquartile fences of their series."""
    quart = df.groupBy(*keys).agg(F.percentile(target, [0.25, 0.75]).alias("_q")).select(
        *keys, F.col("_q")[0].alias("Q1"), F.col("_q")[1].alias("Q3")
    )
    iqr = F.col("Q3") - F.col("Q1")
    fenced = quart.withColumn("Lower_Fence", F.col("Q1") - whisker * iqr).withColumn(
        "Upper_Fence", F.col("Q3") + whisker * iqr
    )
    return df.join(fenced, list(keys)).where(~F.col(target).between(F.col("Lower_Fence"), F.col("Upper_Fence")))


def iqr_outliers_in_groups(
    df: DataFrame, keys: Sequence[str], target: str = TARGET, few: bool = False
) -> DataFrame:
    """The same for groups without a size bound (all rows, a store type, a model)."""
    return box_outliers(df, target, keys, few=few)


def three_sigma(results: DataFrame, measure: str = "MAPE") -> DataFrame:
    """Whether the worst error lies beyond mean + 3 standard deviations."""
    return results.agg(
        F.avg(measure).alias("Mean"), F.stddev_samp(measure).alias("Std"), F.max(measure).alias("Worst")
    ).withColumn("Threshold", F.col("Mean") + 3 * F.col("Std")).withColumn(
        "Beyond_3_Sigma", F.col("Worst") > F.col("Threshold")
    )


def _moments(df: DataFrame, keys: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """Count, mean and variance of each factor in outlying and normal weeks: one row per (keys, factor)."""
    odd = F.col("Is_Weekly_Outlier")
    sides = (("Outlier", odd), ("Normal", ~odd))
    flat = df.groupBy(*keys).agg(*[
        fn(F.when(cond, F.col(f))).alias(f"{stat}_{side}_{f}")
        for f in factors
        for side, cond in sides
        for stat, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    ])
    rows = F.array(*[
        F.struct(F.lit(f).alias("Feature"), *[
            F.col(f"{stat}_{side}_{f}").alias(f"{stat}_{side}") for side, _ in sides for stat in ("n", "mean", "var")
        ])
        for f in factors
    ])
    return flat.select(*keys, F.inline(rows))


def factor_comparison(flagged: DataFrame, keys: Sequence[str] = KEYS, factors: Sequence[str] = FACTORS) -> DataFrame:
    """Mean of each factor in outlying and in normal weeks, long form, for every series with both kinds."""
    odd = F.col("Is_Weekly_Outlier")
    sides = (("Outlier Weeks", odd), ("Normal Weeks", ~odd))
    flat = flagged.groupBy(*keys).agg(
        F.count_if(odd).alias("_odd"),
        F.count_if(~odd).alias("_even"),
        *[mean_over(f, cond).alias(f"{f}|{label}") for f in factors for label, cond in sides],
    ).where("_odd > 0 and _even > 0")
    rows = F.array(*[
        F.struct(F.lit(f).alias("Feature"), F.lit(label).alias("Week_Type"), F.col(f"`{f}|{label}`").alias("Value"))
        for f in factors
        for label, _ in sides
    ])
    return flat.select(*keys, F.inline(rows))


def factor_ttest(
    flagged: DataFrame, keys: Sequence[str] = KEYS, factors: Sequence[str] = FACTORS, alpha: float = 0.05
) -> DataFrame:
    """Pooled-variance two-sample t-test of each factor, outlying against normal weeks of a series.

    Without any spread the statistic is infinite where the means differ, unknown where they agree.
    """
    m = _moments(flagged, keys, factors).where("n_Outlier > 0 and n_Normal > 0")
    dof = F.col("n_Outlier") + F.col("n_Normal") - 2
    part = lambda side: F.coalesce((F.col(f"n_{side}") - 1) * F.col(f"var_{side}"), F.lit(0.0))
    pooled = F.try_divide(part("Outlier") + part("Normal"), dof.cast("double"))
    scale = F.sqrt(pooled * (F.lit(1.0) / F.col("n_Outlier") + F.lit(1.0) / F.col("n_Normal")))
    gap = F.col("mean_Outlier") - F.col("mean_Normal")
    statistic = F.when((scale == 0) & (gap != 0), F.signum(gap) * F.lit(float("inf"))).otherwise(F.try_divide(gap, scale))
    return (
        m.withColumn("DoF", dof)
        .withColumn("T_Statistic", statistic)
        .withColumn("P_Value", student_t_p(F.col("T_Statistic"), F.col("DoF").cast("double")))
        .withColumn("Significant", F.col("P_Value") < alpha)
        .select(*keys, "Feature", "n_Outlier", "n_Normal", "DoF", "T_Statistic", "P_Value", "Significant")
    )


def contrast_sample(levels: DataFrame, seed: int = 42) -> DataFrame:
    """One outlying and one normal series, picked repeatably, with mean, spread and variation."""
    labelled = levels.withColumn("Kind", F.when(F.col("Is_Outlier"), "Outlier Dept").otherwise("Normal Dept"))
    picked = best_per_group(
        labelled.withColumn("_h", key_digest(("Store", "Dept"), seed)), "_h", ("Kind",), ties=("Store", "Dept")
    )
    return picked.select("Kind", "Store", "Dept", "Mean", "Std", ratio("Std", "Mean").alias("CV"))


def kind_sales(df: DataFrame, levels: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """Sales rows labelled by whether their series is outlying: the input of the distribution comparison."""
    kinds = levels.select(*keys, F.when(F.col("Is_Outlier"), "Outlier Dept").otherwise("Normal Dept").alias("Type"))
    return df.select(*keys, F.col(target).alias("Sales")).join(kinds, list(keys)).select("Type", *keys, "Sales")


def sampled_sales(df: DataFrame, levels: DataFrame, seed: int = 42, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """Sales rows of the one outlying and the one normal series of ``contrast_sample``: the pair's distributions."""
    picked = contrast_sample(levels, seed).select(F.col("Kind").alias("Type"), *keys)
    return df.select(*keys, F.col(target).alias("Sales")).join(picked, list(keys)).select("Type", *keys, "Sales")
