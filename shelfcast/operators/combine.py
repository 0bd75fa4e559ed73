"""Joins, lookups, unions and reshaping, all on equality keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.calendar import week_sunday
from shelfcast.names import DATE, HOLIDAY, KEYS, MODEL_ORDER


def join_features(sales: DataFrame, features: DataFrame, keep_both_flags: bool = False) -> DataFrame:
    """Weekly sales with the store-week features; the holiday flag of the sales side is kept."""
    if keep_both_flags:
        left = sales.withColumnRenamed(HOLIDAY, f"{HOLIDAY}_x")
        right = features.withColumnRenamed(HOLIDAY, f"{HOLIDAY}_y")
    else:
        left, right = sales, features.drop(HOLIDAY)
    return left.join(right, ["Store", DATE], "left")


def join_stores(sales: DataFrame, stores: DataFrame) -> DataFrame:
    return sales.join(stores, "Store", "left")


def join_trends(sales: DataFrame, weekly_trends: DataFrame) -> DataFrame:
    """Add weekly search interest by the Sunday that starts the week.

    The Sunday names a week uniquely, also around New Year, so no sales row is duplicated.
    """
    trends = weekly_trends.drop("YearWeek").withColumnRenamed(DATE, "_sunday")
    return sales.withColumn("_sunday", week_sunday(DATE)).join(trends, "_sunday", "left").drop("_sunday")


def measures_side_by_side(
    left: DataFrame, right: DataFrame, measures: Sequence[str], suffixes: tuple[str, str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Inner join of two tables that carry the same measures, told apart by suffix."""
    rename = lambda df, s: df.withColumnsRenamed({m: m + s for m in measures})
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), list(keys))


def left_with_default(
    df: DataFrame, attributes: DataFrame, defaults: dict[str, float], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Left join to optional attributes; the listed ones get a default where nothing matched."""
    joined = df.join(attributes, list(keys), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def keep_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str] = KEYS, pairwise: bool = True) -> DataFrame:
    """Rows whose key is listed: as a combination, or with each part listed on its own."""
    if pairwise:
        return df.join(listed.select(*keys).distinct(), list(keys), "left_semi")
    return reduce(lambda d, k: d.join(listed.select(k).distinct(), k, "left_semi"), keys, df)


def drop_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str] = KEYS, pairwise: bool = True) -> DataFrame:
    """The complement of ``keep_listed``."""
    if pairwise:
        return df.join(listed.select(*keys).distinct(), list(keys), "left_anti")
    flagged = df
    for k in keys:
        part = listed.select(k).distinct().withColumn(f"_in_{k}", F.lit(True))
        flagged = flagged.join(part, k, "left")
    in_all = reduce(lambda a, b: a & b, [F.col(f"_in_{k}").isNotNull() for k in keys])
    return flagged.where(~in_all).select(*df.columns)


def model_rank(model: Column | str = "Model", order: Sequence[str] = MODEL_ORDER) -> Column:
    """Position of a model in the tie-break order; unknown models come last."""
    c = F.col(model) if isinstance(model, str) else model
    position = F.array_position(F.array(*[F.lit(m) for m in order]), c)
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1))


def best_per_group(
    df: DataFrame, measure: str, keys: Sequence[str] = KEYS, ties: Sequence[Column | str] | None = None
) -> DataFrame:
    """The whole row with the smallest measure of each group, as one aggregation (no sort, no window)."""
    ties = [model_rank(), "Model"] if ties is None else list(ties)
    tie_cols = [F.col(t) if isinstance(t, str) else t for t in ties]
    order = F.struct(F.col(measure), *[t.alias(f"_t{i}") for i, t in enumerate(tie_cols)])
    rest = [c for c in df.columns if c not in keys]
    best = df.where(F.col(measure).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col("_best").getField(c).alias(c) for c in df.columns])


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each group in an explicit order, as one aggregation."""
    return best_per_group(
        df.withColumn("_first", F.lit(0)), "_first", keys, ties=list(order)
    ).drop("_first")


def join_by_row_id(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Columns of two tables side by side, matched on an explicit row id instead of by position."""
    return left.join(right, row_id)


def side_by_side(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Two numbered tables (``sources.readers.read_numbered``) put beside each other by position.

    The longer one keeps all its rows; columns of the shorter one are NULL there. Column names must differ.
    """
    twice = (set(left.columns) & set(right.columns)) - {row_id}
    if twice:
        raise ValueError(f"both tables have {sorted(twice)}")
    return left.join(right, row_id, "full")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a part lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_labelled(parts: dict[str, DataFrame], label: str = "Type") -> DataFrame:
    return stack([df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot_mean(df: DataFrame, rows: str, column: str, values: Sequence, measure: str) -> DataFrame:
    return df.groupBy(rows).pivot(column, list(values)).agg(F.avg(measure))


def one_hot(df: DataFrame, col: str, levels: Sequence[str], drop_first: bool = False) -> DataFrame:
    """0/1 column per level; an unknown level is all zeros."""
    used = list(levels)[1:] if drop_first else list(levels)
    return df.withColumns({
        f"{col}_{v}": F.when(F.col(col) == v, 1).otherwise(0) for v in used
    }).drop(col)


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop the named columns that exist."""
    return df.drop(*names)


def optional_in(df: DataFrame, **selections: Sequence | None) -> DataFrame:
    """Multi-select filters: an empty or missing selection means "all"."""
    for col, chosen in selections.items():
        if chosen:
            df = df.where(F.col(col).isin(list(chosen)))
    return df


def apply_filters(
    df: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    stores: Sequence[int] | None = None,
    depts: Sequence[int] | None = None,
    holiday: bool | None = None,
) -> DataFrame:
    """The dashboard's filter set; every filter is optional.

    On a stored weekly table the filters reach the scan. On weeks that are summed from lines, bounds on dates and
    departments are given to ``Warehouse.sales`` too, which turns them into bounds on the stored columns.
    """
    if date_from:
        df = df.where(F.col(DATE) >= F.to_date(F.lit(date_from)))
    if date_to:
        df = df.where(F.col(DATE) <= F.to_date(F.lit(date_to)))
    if holiday is not None:
        df = df.where(F.col(HOLIDAY).cast("boolean") == F.lit(holiday))
    return optional_in(df, Store=stores, Dept=depts)


def top_k(df: DataFrame, measure: str, k: int, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Top or bottom k rows; planned as a per-task heap plus a merge of k-row lists."""
    first = F.desc_nulls_last(measure) if largest else F.asc_nulls_last(measure)
    return df.orderBy(first, *ties).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], measure: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """Top k of each group; the rank limit is applied before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*keys).orderBy(F.desc(measure), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distinct_sorted(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def key_digest(keys: Sequence[str], seed: int = 42) -> Column:
    """Hex digest of a row's key: the same in every engine, whatever the partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def fixed_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Repeatable sample of n rows: those with the n smallest key digests."""
    return df.orderBy(key_digest(keys, seed), *keys).limit(n)


# Advice texts per outlier cause.
CAUSE_ADVICE = (
    ("Holiday-Driven", 1, "Develop holiday-specific forecast models"),
    ("Holiday-Driven", 2, "Create holiday inventory buffers 2-3 weeks in advance"),
    ("Holiday-Driven", 3, "Analyze historical holiday patterns separately"),
    ("Holiday-Driven", 4, "Consider promotional calendars when forecasting"),
    ("Fuel_Price Shock", 1, "Monitor fuel prices as early warning signal"),
    ("Fuel_Price Shock", 2, "Incorporate fuel price elasticity in demand models"),
    ("Fuel_Price Shock", 3, "Adjust pricing strategies when fuel spikes"),
    ("Fuel_Price Shock", 4, "Consider fuel price in transportation cost planning"),
    ("CPI Shock", 1, "Track CPI changes as demand indicator"),
    ("CPI Shock", 2, "Adjust price points based on inflation"),
    ("CPI Shock", 3, "Review product mix when CPI shifts"),
    ("CPI Shock", 4, "Consider economic indicators in long-term planning"),
    ("Unemployment Shock", 1, "Monitor local employment trends"),
    ("Unemployment Shock", 2, "Adjust inventory for changing demand patterns"),
    ("Unemployment Shock", 3, "Consider value-oriented products when unemployment rises"),
    ("Unemployment Shock", 4, "Review staffing levels based on economic indicators"),
    ("Seasonal Peak", 1, "Build seasonal profiles for Q4"),
    ("Seasonal Peak", 2, "Plan inventory buildup 2 months in advance"),
    ("Seasonal Peak", 3, "Create seasonal staffing plans"),
    ("Seasonal Peak", 4, "Develop post-holiday clearance strategies"),
    ("Temperature Extreme", 1, "Use weather forecasts in short-term planning"),
    ("Temperature Extreme", 2, "Adjust category mix based on weather"),
    ("Temperature Extreme", 3, "Create weather-triggered promotions"),
    ("Temperature Extreme", 4, "Plan inventory for weather-sensitive products"),
    ("Unknown", 1, "Investigate these outliers manually"),
    ("Unknown", 2, "Check for data quality issues"),
    ("Unknown", 3, "Look for one-time events (closures, renovations)"),
    ("Unknown", 4, "Consider external factors not in data"),
)


def cause_advice(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAUSE_ADVICE), "Cause string, seq int, advice string")
