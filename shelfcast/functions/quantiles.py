"""Exact quantiles, box summaries and histograms that never hold a whole group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is right for
a series (one value per week) but not for "all sales" or "all sales of one store type". For such
groups the rank is found in two passes: a bounded sketch brackets every requested rank, then only
the values inside the bracket are counted, and ordered in many slices side by side. The answer is
exact; a bracket that missed its rank raises instead of returning a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKETCH_ACCURACY = 10_000
SLICES = 1_000


def attach_scalars(df: DataFrame, one_row: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Add the columns of a one-row aggregate to every row through a scalar subquery."""
    names = list(names or one_row.columns)
    packed = one_row.select(F.struct(*names).alias("_packed")).scalar()
    return df.withColumn("_scalars", packed).select(
        *df.columns, *[F.col("_scalars").getField(n).alias(n) for n in names]
    )


def few_groups(df: DataFrame, keys: Sequence[str], at_most: int = 100_000) -> bool:
    """Whether the keys take so few values that one row per value may be broadcast.

    Counts them (reading the key columns only), so use it on a written table or a dimension.
    """
    return df.select(*keys).distinct().limit(at_most + 1).count() <= at_most


def attach_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """Join per-group aggregates back to rows; no keys means one global group.

    ``few`` says that the number of groups is known to be small: the rows then stay where they are
    and the aggregates are broadcast. Otherwise the optimizer decides by size, and its adaptive skew
    join splits a hot key, which a window could not.
    """
    if not keys:
        return attach_scalars(df, stats)
    return df.join(F.broadcast(stats) if few else stats, list(keys), "left")


def exact_quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = SKETCH_ACCURACY,
    few: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles, long form: (keys, prob, value, n). Rows without a key are left out."""
    keys = list(keys)
    probs = [float(p) for p in probs]
    values = df.select(*keys, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())

    slack = 4.0 / accuracy
    lows = [max(p - slack, 0.0) for p in probs]
    highs = [min(p + slack, 1.0) for p in probs]
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx("_v", lows + highs, accuracy).alias("_edges"),
        F.count("_v").alias("_n"),
    )
    k = len(probs)
    edges = [(F.col("_edges")[i], F.col("_edges")[k + i]) for i in range(k)]

    if keys:
        sketched = values.join(F.broadcast(sketch) if few else sketch, keys)
    else:
        sketched = attach_scalars(values, sketch).where(F.col("_n") > 0)

    # One row per distinct value inside a bracket; all other values collapse map-side into one row per
    # gap between brackets, which keeps their number and the values next to the brackets. The edges
    # travel along as a key: they must be the same ones in both steps.
    v = F.col("_v")
    gap = reduce(
        lambda code, edge: code * 3 + F.when(v < edge[0], 0).when(v > edge[1], 2).otherwise(1),
        edges,
        F.lit(0).cast("bigint"),
    )
    inside_any = reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in edges])
    collapsed = (
        sketched.groupBy(*keys, "_n", "_edges", gap.alias("_gap"), F.when(inside_any, v).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )

    brackets = F.array(*[
        F.struct(F.lit(p).alias("prob"), lo.alias("lo"), hi.alias("hi")) for p, (lo, hi) in zip(probs, edges)
    ])
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    slice_no = F.coalesce(F.floor(F.try_divide(F.col("_max") - lo, hi - lo) * SLICES).cast("int"), F.lit(0))
    part = F.when(F.col("_max") < lo, -1).when(F.col("_min") > hi, SLICES + 1).otherwise(slice_no)
    group = [*keys, "prob"]
    counted = (
        collapsed.select(*keys, "_n", "_c", "_min", "_max", F.explode(brackets).alias("_b"))
        .select(*keys, F.col("_b.prob").alias("prob"), "_n", part.alias("_part"), "_c", "_min", "_max")
        .withColumn("_inside", F.when(F.col("_part").between(0, SLICES), F.col("_max")))
        .groupBy(*group, "_n", "_part", "_inside")
        .agg(F.sum("_c").alias("_c"), F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    )

    # Rows before each part: at most one row per part is ordered here.
    parts = counted.groupBy(*group, "_part").agg(F.sum("_c").alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*group, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))

    upto = Window.partitionBy(*group, "_part").orderBy("_inside")
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counted.join(offsets, [*group, "_part"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
        .withColumn("_pos", F.col("prob") * (F.col("_n") - 1))
    )
    first, last = F.col("_end") - F.col("_c"), F.col("_end") - 1
    under, over = F.col("_part") < 0, F.col("_part") > SLICES
    known_from, known_to = F.when(under, last).otherwise(first), F.when(over, first).otherwise(last)
    known = F.when(over, F.col("_min")).otherwise(F.col("_max"))
    at = lambda rank: F.max(F.when(rank.between(known_from, known_to), known))
    picked = ranked.groupBy(*group, "_n", "_pos").agg(
        at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi")
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    missed = F.col("_lo").isNull() | F.col("_hi").isNull()
    return picked.select(
        *keys,
        "prob",
        F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        .otherwise(value)
        .alias("value"),
        F.col("_n").alias("n"),
    )


def quantiles_wide(
    df: DataFrame, col: str, named: dict[str, float], keys: Sequence[str] = (), few: bool = False
) -> DataFrame:
    """One row per group with one named column per quantile, plus ``n``."""
    long = exact_quantiles(df, col, list(named.values()), keys, few=few)
    picks = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in named.items()]
    return long.groupBy(*keys).agg(*picks, F.max("n").alias("n"))


QUARTILES = {"Q1": 0.25, "Median": 0.5, "Q3": 0.75}


def with_fences(
    df: DataFrame, col: str, keys: Sequence[str] = (), whisker: float = 1.5, few: bool = False
) -> DataFrame:
    """Rows plus quartiles and the interquartile fences of their group."""
    quart = quantiles_wide(df, col, QUARTILES, keys, few).withColumnRenamed("n", "_group_n")
    iqr = F.col("Q3") - F.col("Q1")
    quart = quart.withColumn("Lower_Fence", F.col("Q1") - whisker * iqr).withColumn(
        "Upper_Fence", F.col("Q3") + whisker * iqr
    )
    return attach_group_stats(df, quart.drop("_group_n"), keys, few)


def box_summary(
    df: DataFrame, col: str, keys: Sequence[str] = (), whisker: float = 1.5, few: bool = False
) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and the number of points outside."""
    rows = with_fences(df.where(F.col(col).isNotNull()), col, keys, whisker, few)
    inside = F.col(col).between(F.col("Lower_Fence"), F.col("Upper_Fence"))
    return rows.groupBy(*keys).agg(
        F.max("Q1").alias("Q1"),
        F.max("Median").alias("Median"),
        F.max("Q3").alias("Q3"),
        F.min(F.when(inside, F.col(col))).alias("Lower_Whisker"),
        F.max(F.when(inside, F.col(col))).alias("Upper_Whisker"),
        F.count_if(~inside).alias("Outliers"),
        F.count(col).alias("Count"),
    )


def box_outliers(
    df: DataFrame, col: str, keys: Sequence[str] = (), whisker: float = 1.5, few: bool = False
) -> DataFrame:
    """The points drawn outside the whiskers."""
    rows = with_fences(df.where(F.col(col).isNotNull()), col, keys, whisker, few)
    return rows.where(~F.col(col).between(F.col("Lower_Fence"), F.col("Upper_Fence")))


def equal_width_bin(col: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin index; the last bin is closed on the right, a zero-width range is bin 0."""
    width = (high - low) / F.lit(float(bins))
    index = F.floor(F.try_divide(col - low, width)).cast("int")
    return F.when(high == low, F.lit(0)).otherwise(F.least(index, F.lit(bins - 1)))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram with empty bins kept: (bin, bin_start, bin_end, count)."""
    values = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    span = values.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    index = equal_width_bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)
    counts = attach_scalars(values, span).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    frame = span.where(F.col("_lo").isNotNull()).select(
        "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
    )
    return frame.join(counts, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )
