"""Forecasts that need no fitting: previous value, mean, same week last year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.names import DATE, KEYS, TARGET
from shelfcast.operators.combine import stack
from shelfcast.operators.features import series_window

PREDICTION_COLUMNS = ("Actual", "Predicted", "Model")


def naive_columns(
    split_df: DataFrame,
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    bridge: str = "train",
    season: int = 52,
    history: str = "test",
    mean_of: Sequence[str] = ("train",),
) -> DataFrame:
    """Test rows with one column per baseline model, from one pass over each series.

    ``bridge`` is the part whose last value stands before the first test week ("train" or "val"), ``mean_of`` the parts
    that the simple average is taken over.
    ``history`` tells where the seasonal model may look back: in the "test" part only, or in "full".
    """
    w = series_window(keys)
    whole = Window.partitionBy(*keys)
    part = lambda name: F.col("split") == name
    before_test = part("train") if bridge == "train" else part("train") | part("val")
    y = F.col(target)

    enriched = split_df.withColumns({
        "_last": F.max_by(F.when(before_test, y), F.when(before_test, F.col(DATE))).over(whole),
        "Simple Average": F.avg(F.when(F.col("split").isin(*mean_of), y)).over(whole),
        "_prev": F.when(F.lag("split").over(w) == "test", F.lag(target).over(w)),
    })
    if history == "full":
        seasonal = F.lag(target, season).over(w)
    else:
        seasonal = F.when(F.lag("split", season).over(w) == "test", F.lag(target, season).over(w))
    test = enriched.withColumn("_seasonal", seasonal).where(part("test"))
    carried = F.last("_seasonal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return test.withColumns({
        "Naive": F.coalesce("_prev", "_last"),
        "Seasonal Naive": F.coalesce(carried, F.col("Simple Average")),
    }).drop("_last", "_prev", "_seasonal")


def baseline_forecasts(
    split_df: DataFrame,
    models: Sequence[str] = ("Naive", "Simple Average", "Seasonal Naive"),
    keys: Sequence[str] = KEYS,
    target: str = TARGET,
    **options,
) -> DataFrame:
    """Predictions of the baselines for every test week, long form."""
    wide = naive_columns(split_df, keys, target, **options)
    return wide.withColumnRenamed(target, "Actual").unpivot(
        [*keys, DATE, "Actual"], list(models), "Model", "Predicted"
    ).select(*keys, DATE, *PREDICTION_COLUMNS)


def naive_everywhere(df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """Previous actual for every week of every series."""
    return df.withColumn("Naive", F.lag(target).over(series_window(keys)))


def last_train_value(split_df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    train = split_df.where(F.col("split") == "train")
    return train.groupBy(*keys).agg(F.max_by(target, DATE).alias("Last_Train"), F.max(DATE).alias("Last_Date"))


def next_week_forecast(
    scenarios: DataFrame, profile: DataFrame, keys: Sequence[str] = KEYS, lift_threshold: float = 30.0
) -> DataFrame:
    """Next week's sales from a base value (last week, or a model's prediction), raised for a holiday.

    ``scenarios``: keys, Base_Value, Holiday_Next. Carries the method label, the confidence band and
    the holiday alert.
    """
    info = profile.select(*keys, "Recommended", "Confidence", "CV", "HolidayLift%")
    lift = F.col("HolidayLift%")
    adjusted = F.col("Holiday_Next") & F.coalesce(lift > lift_threshold, F.lit(False))
    text = F.format_number(lift, 1)
    return scenarios.join(info, list(keys)).select(
        *keys,
        "Base_Value",
        "Holiday_Next",
        "Recommended",
        F.when(adjusted, F.col("Base_Value") * (1 + lift / 100)).otherwise(F.col("Base_Value")).alias("Predicted"),
        F.when(adjusted, F.concat(F.lit("Holiday Adjusted (+"), text, F.lit("%)")))
        .when(F.col("Recommended").isin("XGBOOST", "ENSEMBLE"), "XGBoost")
        .otherwise("Naive Forecast (last week)")
        .alias("Method"),
        F.when(F.col("CV") < 0.3, "High").when(F.col("CV") > 0.8, "Low").otherwise("Medium").alias("Confidence_Level"),
        adjusted.alias("Holiday_Alert"),
    )


def latest_scenarios(df: DataFrame, holiday_next, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """One scenario per series: its last known week as base, the following week's holiday flag."""
    last = df.groupBy(*keys).agg(F.max_by(target, DATE).alias("Base_Value"), F.max(DATE).alias("_last"))
    return last.withColumn("Holiday_Next", holiday_next(F.date_add("_last", 7))).drop("_last")


def history_with_forecast(
    df: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET
) -> DataFrame:
    """All history plus one forecast point per series, a week after its last date."""
    last = df.groupBy(*keys).agg(F.max(DATE).alias("_last"))
    point = forecast.join(last, list(keys)).select(
        *keys, F.date_add("_last", 7).alias(DATE), F.col("Predicted").alias(target), F.lit("Forecast").alias("Type")
    )
    history = df.select(*keys, DATE, target, F.lit("Historical").alias("Type"))
    return stack([history, point])
