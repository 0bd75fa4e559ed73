"""The enriched weekly fact table and the time-series features on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from shelfcast.functions.calendar import iso_week, week_sunday, year_week
from shelfcast.functions.quantiles import attach_group_stats, attach_scalars
from shelfcast.names import DATE, HOLIDAY, KEYS, TARGET, TREND_PREFIX
from shelfcast.operators.cleaning import clean_sales
from shelfcast.operators.combine import join_features, join_stores, join_trends, key_digest


def series_window(keys: Sequence[str] = KEYS, order: str = DATE) -> WindowSpec:
    """One series in date order. A series has one row per week, so the calendar bounds the window."""
    return Window.partitionBy(*keys).orderBy(order)


def weekly_trends(
    daily_wide: DataFrame, terms: Sequence[str], lags: Sequence[int] = (1, 2, 4), prefix: str = TREND_PREFIX
) -> DataFrame:
    """Daily search interest to means per Sunday week, with the values of earlier weeks.

    The first weeks, whose lags are unknown, are dropped.
    """
    weekly = daily_wide.groupBy(week_sunday("date").alias(DATE)).agg(
        *[F.avg(t).alias(prefix + t) for t in terms]
    )
    cols = [prefix + t for t in terms]
    lagged = row_lags(weekly, cols, lags).dropna()
    return lagged.select(DATE, year_week(DATE).alias("YearWeek"), *[c for c in lagged.columns if c != DATE])


def row_lags(weekly: DataFrame, cols: Sequence[str], lags: Sequence[int], order: str = DATE) -> DataFrame:
    """Lags by row position on a table with one row per week of the calendar (a few hundred rows)."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return weekly.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags})


def fill_trends_on_calendar(weekly: DataFrame, weeks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Weekly interest for every listed Sunday; a week without a value repeats the last known one."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weeks.join(weekly, DATE, "full").withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def build_fact(sales: DataFrame, features: DataFrame, stores: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """Raw tables to the enriched, cleaned weekly fact, as one lazy plan."""
    fact = clean_sales(join_stores(join_features(sales, features), stores))
    if trends is None:
        return fact
    cols = [c for c in trends.columns if c.startswith(TREND_PREFIX)]
    weeks = sales.select(week_sunday(DATE).alias(DATE)).distinct()
    filled = fill_trends_on_calendar(trends.drop("YearWeek"), weeks, cols)
    return join_trends(fact, filled).withColumn("YearWeek", year_week(DATE))


def lag_features(
    df: DataFrame, lags: Sequence[int] = (1, 4), rolling: int | None = 4, keys: Sequence[str] = KEYS, target: str = TARGET
) -> DataFrame:
    """Earlier sales of the series, and the mean of the ``rolling`` weeks before (NULL until all exist)."""
    w = series_window(keys)
    cols = {f"Lag_{k}": F.lag(target, k).over(w) for k in lags}
    if rolling:
        before = w.rowsBetween(-rolling, -1)
        cols[f"Rolling_Mean_{rolling}"] = F.when(
            F.count(target).over(before) == rolling, F.avg(target).over(before)
        )
    return df.withColumns(cols)


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"Month": F.month(DATE), "Week": iso_week(DATE)})


def holiday_interactions(df: DataFrame) -> DataFrame:
    flag = F.col(HOLIDAY).cast("int")
    return df.withColumns({"Fuel_Holiday": F.col("Fuel_Price") * flag, "CPI_Holiday": F.col("CPI") * flag})


def series_index(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "t") -> DataFrame:
    """0-based position of each week in its series."""
    return df.withColumn(name, F.row_number().over(series_window(keys)) - 1)


def z_score(df: DataFrame, cols: dict[str, str], keys: Sequence[str] = KEYS, few: bool = False) -> DataFrame:
    """Standard scores inside each group: ``cols`` maps a value column to its score column.

    The statistics are pre-aggregated and joined back, so a group with a third of all rows costs
    one row in the shuffle. A group without spread scores 0.
    """
    aggs = [
        a for c in cols for a in (F.avg(c).alias(f"_mean_{c}"), F.stddev_samp(c).alias(f"_sd_{c}"))
    ]
    stats = (df.groupBy(*keys) if keys else df).agg(*aggs)
    joined = attach_group_stats(df, stats, keys, few)
    scores = {
        out: F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")).otherwise(F.lit(0.0))
        for c, out in cols.items()
    }
    return joined.withColumns(scores).select(*df.columns, *cols.values())


def group_min(df: DataFrame, measure: str, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.min(measure).alias(out))
    return attach_group_stats(df, stats, keys)


def label_split(df: DataFrame, train_end: str, val_end: str | None = None, date: str = DATE) -> DataFrame:
    """Chronological parts: train < train_end <= val < val_end <= test; without val_end only train/test."""
    cut = lambda s: F.to_date(F.lit(s))
    split = F.when(F.col(date) < cut(train_end), "train")
    if val_end is not None:
        split = split.when(F.col(date) < cut(val_end), "val")
    return df.withColumn("split", split.when(F.col(date).isNotNull(), "test"))


def quantile_date_split(df: DataFrame, q: float = 0.8, date: str = DATE) -> DataFrame:
    """Train = dates up to the q-quantile of all rows' dates. The buffer holds distinct dates only."""
    cut = df.agg(F.percentile(F.unix_date(date), q).alias("_cut"))
    flagged = attach_scalars(df, cut)
    return flagged.withColumn(
        "split", F.when(F.unix_date(F.col(date)) <= F.col("_cut"), "train").otherwise("test")
    ).drop("_cut")


def hash_split(df: DataFrame, keys: Sequence[str], train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Random split that does not depend on partitioning: the same row always lands on the same side."""
    bucket = F.conv(F.substring(key_digest(keys, seed), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(bucket < train_percent, "train").otherwise("test"))


def with_enough_history(
    df: DataFrame, min_rows: int = 50, min_parts: dict[str, int] | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Series with enough weeks overall and, when ``split`` is labelled, in each part."""
    parts = min_parts or {}
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("split") == p).alias(f"_n_{p}") for p in parts]
    )
    ok = F.col("_n") >= min_rows
    for p, least in parts.items():
        ok = ok & (F.col(f"_n_{p}") >= least)
    return df.join(counts.where(ok).select(*keys), list(keys), "left_semi")


SPLIT_MINIMA = {"train": 20, "val": 10, "test": 10}


def future_weeks(df: DataFrame, n: int, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """The n weeks after each series' last one, on the series' own weekday."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    days = F.sequence(F.date_add("_last", 7), F.date_add("_last", 7 * n), F.expr("interval 7 days"))
    return last.select(*keys, F.posexplode(days).alias("step", date)).withColumn("step", F.col("step") + 1)


def fill_calendar(df: DataFrame, target: str = TARGET, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Every week between a series' first and last, with 0 for weeks without sales."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    weeks = span.select(*keys, F.explode(F.sequence("_first", "_last", F.expr("interval 7 days"))).alias(date))
    return weeks.join(df, [*keys, date], "left").fillna({target: 0.0})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column, Mean, Deviation (population) of each column: a table to store and to apply to other rows later."""
    one = df.agg(F.array(*[
        F.struct(F.lit(c).alias("Column"), F.avg(c).alias("Mean"), F.stddev_pop(c).alias("Deviation")) for c in cols
    ]).alias("_columns"))
    return one.select(F.inline("_columns"))


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and scale ``cols`` by a stored ``fit_scaler`` table. A constant column is centred and not scaled.

    A column that the table lacks becomes NULL.
    """
    pick = lambda c, what: F.max(F.when(F.col("Column") == c, F.col(what)))
    stats = scaler.agg(*[a for c in cols for a in (pick(c, "Mean").alias(f"_m_{c}"), pick(c, "Deviation").alias(f"_s_{c}"))])
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        for c in cols
    }
    return attach_scalars(df, stats).withColumns(scaled).select(*df.columns)


def standardise(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Zero mean, unit variance (population deviation), statistics from the training rows only."""
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols), cols)


def uplift_features(fact: DataFrame) -> DataFrame:
    """Lags, calendar and holiday interactions as used by the uplift models."""
    return holiday_interactions(calendar_features(lag_features(fact)))
