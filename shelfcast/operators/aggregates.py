"""The tables behind the charts: totals, patterns, shares, distributions, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import holiday_season, month_name, period_label, period_start
from shelfcast.functions.quantiles import attach_scalars, exact_quantiles
from shelfcast.functions.scalars import mean_over, ratio
from shelfcast.names import DATE, HOLIDAY, KEYS, TARGET
from shelfcast.operators.combine import best_per_group
from shelfcast.operators.evaluate import best_models


def global_kpis(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Total, mean, median, extremes, spread and number of rows of one measure."""
    basics = df.agg(
        F.sum(target).alias("Total"),
        F.avg(target).alias("Mean"),
        F.min(target).alias("Min"),
        F.max(target).alias("Max"),
        F.stddev_samp(target).alias("Std"),
        F.count(target).alias("Rows"),
    )
    median = exact_quantiles(df, target, [0.5]).select(F.col("value").alias("Median"))
    return attach_scalars(basics, median)


def store_performance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Total, mean and number of records per store with its type and size, best first."""
    return (
        df.groupBy("Store")
        .agg(
            F.sum(target).alias("Total_Sales"),
            F.avg(target).alias("Avg_Sales"),
            F.count(target).alias("Num_Records"),
            F.first("Type", ignorenulls=True).alias("Type"),
            F.first("Size", ignorenulls=True).alias("Size"),
        )
        .orderBy(F.desc("Total_Sales"), "Store")
    )


def holiday_sales(df: DataFrame, target: str = TARGET) -> DataFrame:
    flag = F.when(F.col(HOLIDAY).cast("int") == 1, "Holiday").otherwise("Non-Holiday")
    return df.groupBy(flag.alias(HOLIDAY)).agg(
        F.avg(target).alias("Mean"), F.sum(target).alias("Total"), F.count(target).alias("Weeks")
    )


def total_by_date(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.groupBy(DATE).agg(F.sum(target).alias(target))


def resample(df: DataFrame, unit: str = "day", target: str = TARGET) -> DataFrame:
    """Totals per day, Monday week or month, with the period's label."""
    start = period_start(DATE, unit)
    return df.groupBy(start.alias("Period_Start")).agg(F.sum(target).alias(target)).withColumn(
        "Period", period_label("Period_Start", unit)
    )


def monthly_pattern(df: DataFrame, keys: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    return (
        df.groupBy(*keys, F.month(DATE).alias("Month"))
        .agg(F.avg(target).alias("Mean"), F.count(target).alias("Weeks"))
        .withColumn("Month_Name", month_name("Month"))
    )


def yearly_totals(df: DataFrame, keys: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    return df.groupBy(*keys, F.year(DATE).alias("Year")).agg(
        F.sum(target).alias("Total"), F.avg(target).alias("Mean"), F.count(target).alias("Weeks")
    )


def month_year_pivot(df: DataFrame, years: Sequence[int], target: str = TARGET) -> DataFrame:
    """Mean sales, a row per month and a column per year."""
    wide = (
        df.select(F.month(DATE).alias("Month"), F.year(DATE).alias("Year"), target)
        .groupBy("Month")
        .pivot("Year", list(years))
        .agg(F.avg(target))
    )
    return wide.withColumnsRenamed({str(y): f"Y{y}" for y in years})


def top_means(df: DataFrame, key: str, measure: str, k: int = 20) -> DataFrame:
    return df.groupBy(key).agg(F.avg(measure).alias("Mean")).orderBy(F.desc("Mean"), key).limit(k)


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage of each value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("Count"))
    total = counts.agg(F.sum("Count").alias("_total"))
    return attach_scalars(counts, total).select(
        col, "Count", (F.col("Count") * 100 / F.col("_total")).alias("Percentage")
    )


def status_counts(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct keys, distinct key combinations, and rows.

    Counting over the distinct combinations keeps the buffers small.
    """
    combos = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return combos.agg(
        *[F.countDistinct(k).alias(f"Distinct_{k}") for k in keys],
        F.count(F.lit(1)).alias("Series"),
        F.sum("_rows").alias("Rows"),
    )


def date_extent(df: DataFrame, date: str = DATE) -> DataFrame:
    return df.agg(F.min(date).alias("First"), F.max(date).alias("Last")).withColumn(
        "Days", F.datediff("Last", "First")
    )


def lift_and_season(df: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """Holiday lift in percent and the ratio of November/December to the rest, per series."""
    season = holiday_season(DATE)
    return df.groupBy(*keys).agg(
        ((ratio(mean_over(target, F.col(HOLIDAY).cast("int") == 1), mean_over(target, F.col(HOLIDAY).cast("int") == 0)) - 1) * 100)
        .alias("Holiday_Lift"),
        ratio(mean_over(target, season), mean_over(target, ~season)).alias("Seasonal_Ratio"),
    )


def describe_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per numeric column: one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quart = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ("column",), few=True)
    wide = quart.groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
    ])
    return basics.join(wide, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def profile_table(df: DataFrame, numeric: Sequence[str], date: str | None = DATE, exact: bool = True) -> DataFrame:
    """Shape, types, missing values, distinct counts and date range of a table, as (metric, column, value) text.

    Distinct counts are exact: each column's values are grouped in the tasks, then over all. ``exact`` off estimates them
    in the one pass that counts the rest.
    """
    cols = df.columns
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"missing|{c}") for c in cols]
    counted = [c for c in cols if c not in numeric]
    if not exact:
        aggs += [F.approx_count_distinct(c).alias(f"distinct|{c}") for c in counted]
    if date:
        aggs += [F.min(date).alias("first"), F.max(date).alias("last")]
    one = df.agg(*aggs)
    if exact and counted:
        values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(counted)])))
        sizes = values.where(F.col("_v").isNotNull()).distinct().groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
        wide = sizes.agg(*[F.coalesce(F.max(F.when(F.col("_c") == i, F.col("_n"))), F.lit(0)).alias(f"distinct|{c}") for i, c in enumerate(counted)])
        one = attach_scalars(one, wide)
    text = lambda c: F.col(f"`{c}`").cast("string")
    row = lambda metric, column, value: F.struct(
        F.lit(metric).alias("metric"), F.lit(column).alias("column"), value.alias("value")
    )
    rows = [row("rows", "", text("rows")), row("columns", "", F.lit(str(len(cols))))]
    rows += [row("type", c, F.lit(types[c])) for c in cols]
    rows += [row("missing", c, text(f"missing|{c}")) for c in cols]
    rows += [row("distinct", c, text(f"distinct|{c}")) for c in cols if c not in numeric]
    if date:
        rows += [row("first", date, text("first")), row("last", date, text("last"))]
    return one.select(F.inline(F.array(*rows)))


def compare_datasets(named: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Rows, distinct series and date range of several datasets: name -> (table, date column, series keys)."""
    parts = []
    for name, (df, date, keys) in named.items():
        series = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(date).alias("_a"), F.max(date).alias("_b"))
        parts.append(series.agg(
            F.sum("_n").alias("Rows"),
            F.count(F.lit(1)).alias("Series"),
            F.min("_a").alias("First"),
            F.max("_b").alias("Last"),
        ).select(F.lit(name).alias("Dataset"), "Rows", "Series", "First", "Last", F.datediff("Last", "First").alias("Days")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metric_means(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.avg(m).alias(m) for m in metrics])
    return one.unpivot([], list(metrics), "Metric", "Mean")


def top_n_share(df: DataFrame, measure: str, n: int) -> DataFrame:
    """Share in percent of the n largest values in the total."""
    top = df.orderBy(F.desc(measure)).limit(n).agg(F.sum(measure).alias("Top"))
    total = df.agg(F.sum(measure).alias("Total"))
    return attach_scalars(top, total).withColumn("Share", ratio("Top", "Total") * 100)


def summary_report(results: DataFrame, sales: DataFrame, keys: Sequence[str] = KEYS, target: str = TARGET) -> DataFrame:
    """The downloadable report: (Metric, Value) with numbers as numbers; the best model's name in its own column."""
    # Smallest name on equal counts; the buffer holds one entry per model.
    mode = best_models(results, keys).agg(F.mode("Model", True).alias("_mode"))
    series = results.groupBy(*keys).agg(
        F.count("MAPE").alias("_n"), F.sum("MAPE").alias("_s"), F.min("MAPE").alias("_lo"), F.max("MAPE").alias("_hi")
    )
    errors = series.agg(
        F.countDistinct("Dept").cast("double").alias("Total Departments"),
        F.count(F.lit(1)).cast("double").alias("Total Series"),
        (F.sum("_s") / F.sum("_n")).alias("Average MAPE"),
        F.min("_lo").alias("Best MAPE"),
        F.max("_hi").alias("Worst MAPE"),
    )
    weekly = total_by_date(sales, target=target).agg(
        (F.avg(target) * 52).alias("Total Annual Sales"), F.sum(target).alias("Total Sales")
    )
    wide = attach_scalars(attach_scalars(errors, weekly), mode)
    numbers = [c for c in wide.columns if c != "_mode"]
    row = lambda metric, value, text: F.struct(
        F.lit(metric).alias("Metric"), value.alias("Value"), text.alias("Text")
    )
    no_text, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = F.array(
        *[row(c, F.col(f"`{c}`"), no_text) for c in numbers],
        row("Most Common Best Model", no_value, F.col("_mode")),
    )
    return wide.select(F.inline(rows))


def extreme_rows(df: DataFrame, measure: str, ties: Sequence[str]) -> DataFrame:
    """The single rows with the smallest and the largest value."""
    low = best_per_group(df.withColumn("Which", F.lit("lowest")), measure, ("Which",), ties=list(ties))
    high = best_per_group(
        df.withColumn("Which", F.lit("highest")).withColumn("_neg", -F.col(measure)), "_neg", ("Which",), ties=list(ties)
    ).drop("_neg")
    return low.unionByName(high)
