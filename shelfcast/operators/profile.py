"""Series profiles and the rules that turn them into a model recommendation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import holiday_season
from shelfcast.functions.scalars import coefficient_of_variation, mean_over, ratio, round_half_even
from shelfcast.names import DATE, HOLIDAY, KEYS, MARKDOWNS, TARGET
from shelfcast.operators.features import series_index


def _any_promo(df: DataFrame, markdowns: Sequence[str]) -> Column:
    present = [c for c in markdowns if c in df.columns]
    hits = [F.coalesce(F.col(c) > 0, F.lit(False)) for c in present]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _guarded(num: Column, den: Column, otherwise: float, value: Column) -> Column:
    """``value`` where the denominator is positive, else the fallback; NULL numerators stay NULL."""
    return F.when(den > 0, value).otherwise(F.lit(otherwise))


def series_metrics(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    markdowns: Sequence[str] = MARKDOWNS,
    min_rows: int = 50,
    trend_rows: int = 10,
) -> DataFrame:
    """Unrounded profile of every series with at least ``min_rows`` weeks."""
    y = F.col(target)
    on_holiday = F.col(HOLIDAY).cast("int") == 1
    season = holiday_season(DATE)
    rows = series_index(df.withColumn("_promo", _any_promo(df, markdowns)), keys, "_t")
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("DataPoints"),
        F.avg(y).alias("_mean"),
        mean_over(y, on_holiday).alias("_holiday"),
        mean_over(y, F.col(HOLIDAY).cast("int") == 0).alias("_normal"),
        mean_over(y, season).alias("_season"),
        mean_over(y, ~season).alias("_rest"),
        coefficient_of_variation(y).alias("CV"),
        F.count_if(y == 0).alias("_zeros"),
        F.regr_slope(y, F.col("_t")).alias("_slope"),
        F.count_if("_promo").alias("_promo_weeks"),
        mean_over(y, F.col("_promo")).alias("_promo_mean"),
        mean_over(y, ~F.col("_promo")).alias("_no_promo_mean"),
    )
    lift = lambda a, b: _guarded(F.col(a), F.col(b), 0.0, (ratio(a, b) - 1) * 100)
    return agg.where(F.col("DataPoints") >= min_rows).select(
        *keys,
        "DataPoints",
        lift("_holiday", "_normal").alias("HolidayLift%"),
        _guarded(F.col("_season"), F.col("_rest"), 1.0, ratio("_season", "_rest")).alias("SeasonalRatio"),
        "CV",
        (F.col("_zeros") * 100 / F.col("DataPoints")).alias("ZeroPct"),
        F.when(
            F.col("DataPoints") > trend_rows,
            _guarded(F.col("_slope"), F.col("_mean"), 0.0, ratio(F.abs("_slope"), "_mean") * 100),
        ).otherwise(F.lit(0.0)).alias("TrendStrength"),
        F.when(F.col("_promo_weeks") > 0, lift("_promo_mean", "_no_promo_mean")).otherwise(F.lit(0.0)).alias("PromoLift%"),
    )


def _score(rules: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the points of the rules that hold; an unknown metric scores nothing."""
    return reduce(lambda a, b: a + b, [F.when(cond, points).otherwise(0) for cond, points in rules])


def recommend(metrics: DataFrame) -> DataFrame:
    """Score both model families on the unrounded metrics; a lead of more than one point decides."""
    lift, season, cv = F.col("HolidayLift%"), F.col("SeasonalRatio"), F.col("CV")
    zeros, n, promo, trend = F.col("ZeroPct"), F.col("DataPoints"), F.col("PromoLift%"), F.col("TrendStrength")
    naive = _score([(lift > 50, 3), (season > 2, 2), (cv > 0.8, 2), (zeros > 10, 3), (n < 100, 2), (promo > 30, 1)])
    learned = _score([
        (n >= 100, 2), (cv < 0.5, 2), ((lift > 20) & (lift < 50), 1), (trend > 1, 1), (zeros < 1, 1)
    ])
    total = F.col("Naive_Score") + F.col("XGBoost_Score")
    naive_wins = F.col("Naive_Score") > F.col("XGBoost_Score") + 1
    learned_wins = F.col("XGBoost_Score") > F.col("Naive_Score") + 1
    return (
        metrics.withColumn("Naive_Score", naive)
        .withColumn("XGBoost_Score", learned)
        .withColumn("Recommended", F.when(naive_wins, "NAIVE").when(learned_wins, "XGBOOST").otherwise("ENSEMBLE"))
        .withColumn(
            "Confidence",
            F.when(naive_wins, ratio("Naive_Score", total))
            .when(learned_wins, ratio("XGBoost_Score", total))
            .otherwise(F.lit(0.5)),
        )
    )


# Decimals of the published profile.
PROFILE_DIGITS = {"HolidayLift%": 1, "SeasonalRatio": 2, "CV": 2, "ZeroPct": 1, "PromoLift%": 1}


def round_profile(recommended: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return recommended.select(
        *keys,
        "Recommended",
        "Confidence",
        "DataPoints",
        *[round_half_even(c, d).alias(c) for c, d in PROFILE_DIGITS.items()],
    )


def profile(df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """The published profile table: recommendation, confidence and rounded metrics per series."""
    return round_profile(recommend(series_metrics(df, keys, target)), keys)


def classify_all(df: DataFrame, keys: Sequence[str] = KEYS, min_rows: int = 50) -> DataFrame:
    """Recommendation for every series, short ones included with a label and no confidence."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    judged = recommend(series_metrics(df, keys, min_rows=min_rows)).select(*keys, "Recommended", "Confidence")
    return sizes.join(judged, list(keys), "left").select(
        *keys,
        F.when(F.col("_n") < min_rows, "NAIVE (Insufficient Data)").otherwise(F.col("Recommended")).alias("Recommended"),
        F.when(F.col("_n") < min_rows, 0.0).otherwise(F.col("Confidence")).alias("Confidence"),
        F.col("_n").alias("DataPoints"),
    )


def holiday_rule(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    lift_threshold: float = 1.5,
    season_threshold: float = 2.0,
    min_rows: int = 50,
) -> DataFrame:
    """Holiday-sensitive series keep the naive model, the others take the learned one."""
    y = F.col(target)
    season = holiday_season(DATE)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        mean_over(y, F.col(HOLIDAY).cast("int") == 1).alias("_holiday"),
        mean_over(y, F.col(HOLIDAY).cast("int") == 0).alias("_normal"),
        mean_over(y, season).alias("_season"),
        mean_over(y, ~season).alias("_rest"),
    )
    lift = ratio("_holiday", "_normal") - 1
    known = F.col("_holiday").isNotNull() & F.coalesce(F.col("_normal") != 0, F.lit(True))
    seasonal = F.when(F.col("_rest") > 0, ratio("_season", "_rest")).otherwise(F.lit(1.0))
    sensitive = F.coalesce(lift > lift_threshold, F.lit(False)) | F.coalesce(
        F.col("SeasonalRatio") > season_threshold, F.lit(False)
    )
    return (
        agg.where(F.col("_n") >= min_rows)
        .withColumn("SeasonalRatio", F.when(known, seasonal))
        .withColumn("HolidayLift%", F.when(known, lift * 100).otherwise(F.lit(0.0)))
        .withColumn("IsHolidayDept", known & sensitive)
        .select(
            *keys,
            "IsHolidayDept",
            "HolidayLift%",
            "SeasonalRatio",
            F.when(F.col("IsHolidayDept"), "Naive").otherwise("XGBoost").alias("Recommended_Model"),
        )
    )


def sales_character(df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """Level, spread and emptiness of every series. The median buffer is bounded by the weeks of a series."""
    y = F.col(target)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("Weeks"),
        F.avg(y).alias("Mean"),
        F.median(y).alias("Median"),
        F.stddev_samp(y).alias("Std"),
        F.min(y).alias("Min"),
        F.max(y).alias("Max"),
        coefficient_of_variation(y).alias("CV"),
        F.count_if(y == 0).alias("ZeroWeeks"),
        (F.count_if(y == 0) * 100 / F.count(F.lit(1))).alias("ZeroPct"),
        (F.count_if(y > 0) * 100 / F.count(F.lit(1))).alias("SalesFrequency"),
    )


def diagnose_volatility(character: DataFrame) -> DataFrame:
    """First matching class of erratic demand."""
    return character.withColumn(
        "Diagnosis",
        F.when(F.col("Std") > F.col("Mean") * 2, "EXTREME VOLATILITY")
        .when(F.col("ZeroWeeks") > F.col("Weeks") * 0.5, "INTERMITTENT DEMAND")
        .when(F.col("Max") > F.col("Mean") * 10, "EXTREME SPIKES")
        .otherwise("MYSTERIOUS - NEED DEEPER DIVE"),
    )


def confidence_band(df: DataFrame, cv: str = "CV") -> DataFrame:
    return df.withColumn(
        "Confidence_Band",
        F.when(F.col(cv) < 0.3, "High Confidence - Stable Department")
        .when(F.col(cv) > 0.8, "Low Confidence - Highly Volatile")
        .otherwise("Medium Confidence"),
    )


def recommendation_advice(df: DataFrame) -> DataFrame:
    """Short advice per recommendation, with the confidence as a percentage."""
    text = (
        F.when(F.col("Recommended") == "XGBOOST", "Stable department - ML can help")
        .when(F.col("Recommended") == "NAIVE", "Holiday-sensitive - Keep it simple")
        .otherwise("Borderline case - use ensemble")
    )
    share = F.round(F.col("Confidence") * 100, 0).cast("int").cast("string")
    label = F.concat(F.col("Recommended"), F.lit(" (Confidence: "), share, F.lit("%)"))
    return df.withColumn("Advice", text).withColumn("Label", label)


# Advice per volatility class; the last entry serves every other class.
DIAGNOSIS_ADVICE = (
    ("EXTREME VOLATILITY", 1, 'Report this as a finding: "Some departments show extreme volatility"'),
    ("EXTREME VOLATILITY", 2, "Consider removing from analysis OR using specialized models"),
    ("EXTREME VOLATILITY", 3, "Mention in limitations: \"Very volatile departments are harder to forecast\""),
    ("INTERMITTENT DEMAND", 1, "Use specialized models for intermittent demand (Croston's method)"),
    ("INTERMITTENT DEMAND", 2, "Report as a separate case study"),
    ("INTERMITTENT DEMAND", 3, "Show that different products need different approaches"),
    ("OTHER", 1, "Investigate further: Check for data errors"),
    ("OTHER", 2, "Look at promotional periods (MarkDown columns)"),
    ("OTHER", 3, "Check if this department sells seasonal products"),
)


def diagnosis_advice(diagnosed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Advice lines per series, joined on the volatility class."""
    texts = diagnosed.sparkSession.createDataFrame(list(DIAGNOSIS_ADVICE), "_class string, seq int, advice string")
    known = F.col("Diagnosis").isin("EXTREME VOLATILITY", "INTERMITTENT DEMAND")
    return (
        diagnosed.withColumn("_class", F.when(known, F.col("Diagnosis")).otherwise("OTHER"))
        .join(texts, "_class")
        .select(*keys, "Diagnosis", "seq", "advice")
    )


def promo_by_markdown(df: DataFrame, markdowns: Sequence[str] = MARKDOWNS, target: str = TARGET) -> DataFrame:
    """Per markdown column: promoted weeks, mean sales with and without it, lift in percent. One pass."""
    promoted = lambda m: F.coalesce(F.col(m) > 0, F.lit(False))
    flat = df.agg(*[
        a
        for m in markdowns
        for a in (
            F.count_if(promoted(m)).alias(f"n_{m}"),
            mean_over(target, promoted(m)).alias(f"with_{m}"),
            mean_over(target, ~promoted(m)).alias(f"without_{m}"),
        )
    ])
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("MarkDown"),
            F.col(f"n_{m}").alias("Weeks"),
            F.col(f"with_{m}").alias("Promo_Sales"),
            F.col(f"without_{m}").alias("Normal_Sales"),
        )
        for m in markdowns
    ])
    return flat.select(F.inline(rows)).withColumn(
        "Lift%", (ratio("Promo_Sales", "Normal_Sales") - 1) * 100
    )
