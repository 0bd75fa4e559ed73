"""Cleaning and missing-value handling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.quantiles import attach_scalars
from shelfcast.names import DATE, HOLIDAY, KEYS, MARKDOWNS, TARGET


def fill_constant(df: DataFrame, values: Mapping[str, float] | Sequence[str], value: float = 0.0) -> DataFrame:
    """Replace NULL by a constant, per listed column; absent columns are ignored."""
    wanted = dict(values) if isinstance(values, Mapping) else {c: value for c in values}
    present = {c: v for c, v in wanted.items() if c in df.columns}
    return df.fillna(present) if present else df


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, order: str = DATE) -> DataFrame:
    """Carry the last known value forward inside each series, in date order."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in cols})


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def coerce_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to number; what does not parse becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def bool_to_int(df: DataFrame, cols: Sequence[str] = (HOLIDAY,)) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


#: Labels drawn to cut the alphabet, and slices it is cut into, about.
LABELS_DRAWN, LABEL_SLICES = 4_000, 200


def label_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """The encoder as a table: each distinct label with its place in alphabetical order, from 0. NULL has no code.

    The order is cut into slices of about equal numbers of labels, at labels drawn by the order of a hash, so no task orders
    more than its slice, whatever characters the labels share; a label's code is its place there and the labels of the slices before.
    """
    labels = df.select(F.col(col).cast("string").alias("_label")).where(F.col("_label").isNotNull()).distinct()
    drawn = labels.orderBy(F.xxhash64("_label"), "_label").limit(LABELS_DRAWN)
    cuts = drawn.agg(F.sort_array(F.collect_list("_label")).alias("_all"))
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / LABEL_SLICES).cast("int"))
    cuts = cuts.select(F.filter("_all", lambda x, i: i % step == 0).alias("_cuts"))
    own = F.size(F.filter("_cuts", lambda c: c <= F.col("_label")))
    sliced = attach_scalars(labels, cuts).select("_label", own.alias("_slice"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy("_label")) - 1
    ranked = sliced.withColumn("_place", place).join(F.broadcast(sizes), "_slice")  # a row per slice
    return ranked.select(F.col("_label").alias(col), (F.col("_before") + F.col("_place")).cast("int").alias(out))


def label_encode(df: DataFrame, col: str, out: str, codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Alphabetical integer codes of a column, and the table of codes, which can be stored and given again.

    A label that the given codes lack gets the number of codes.
    """
    codes = label_codes(df, col, out) if codes is None else codes
    size = codes.agg(F.count(F.lit(1)).cast("int").alias("_size"))
    coded = df.withColumn(col, F.col(col).cast("string")).join(codes, col, "left")
    return attach_scalars(coded, size).withColumn(out, F.coalesce(out, "_size")).drop("_size"), codes


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, their number and percentage, most first. One pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counts.unpivot("_rows", df.columns, "column", "missing")
        .where("missing > 0")
        .select("column", "missing", (F.col("missing") * 100 / F.col("_rows")).alias("percent"))
        .orderBy(F.desc("missing"), "column")
    )


def remove_negative(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Keep rows with a known, non-negative target."""
    return df.where(F.col(target) >= 0)


def columns_agree(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per column pair: whether both hold the same value on every row."""
    flags = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{a}={b}") for a, b in pairs])
    return flags.unpivot([], flags.columns, "pair", "equal")


def coalesce_duplicate(df: DataFrame, kept: str, duplicate: str, name: str) -> DataFrame:
    """Keep the left of two same-meaning join columns under its plain name."""
    return df.withColumn(name, F.col(kept)).drop(*[c for c in (kept, duplicate) if c != name])


def clean_sales(
    df: DataFrame, markdowns: Sequence[str] = MARKDOWNS, target: str = TARGET, holiday: str = HOLIDAY
) -> DataFrame:
    """The cleaning chain: empty markdowns are 0, negative weeks go, one integer holiday flag stays."""
    df = fill_constant(df, markdowns)
    df = remove_negative(df, target)
    if f"{holiday}_x" in df.columns:
        df = coalesce_duplicate(df, f"{holiday}_x", f"{holiday}_y", holiday)
    return bool_to_int(df, (holiday,))
