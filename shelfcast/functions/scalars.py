"""Small numeric and text expressions with the NULL behaviour the analytics need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that is NULL where the denominator is 0 (ANSI division would raise)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def lift_percent(part: Column | str, base: Column | str) -> Column:
    return (ratio(part, base) - 1) * 100


def share_percent(part: Column | str, total: Column | str) -> Column:
    return ratio(part, total) * 100


def round_half_even(col: Column | str, digits: int) -> Column:
    return F.bround(_c(col), digits)


def clip(col: Column | str, low: float, high: float) -> Column:
    """Limit to a range; NULL stays NULL (greatest/least would skip it)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def at_most(col: Column | str, cap: float) -> Column:
    c = _c(col)
    return F.when(c.isNotNull(), F.least(F.lit(cap), c))


def mean_over(values: Column | str, condition: Column) -> Column:
    """Aggregate: mean of the values whose row meets the condition."""
    return F.avg(F.when(condition, _c(values)))


def hundredths(col: Column | str) -> Column:
    """A number with two decimals as a whole number of hundredths."""
    return F.rint(_c(col) * 100).cast("bigint")


def exact_total(units: Column | str, scale: int) -> Column:
    """Aggregate: sum of whole units, divided by 10**scale, as a double.

    Whole numbers add up to the same total in any order. The upper and lower bits are summed apart,
    so both sums stay in fast 64-bit arithmetic even for a group with most rows of a huge table.
    """
    u, bits = _c(units), 20
    high = F.sum(F.shiftright(u, bits)).cast("decimal(38,0)")
    low = F.sum(u.bitwiseAND(F.lit((1 << bits) - 1)))
    return (high * F.lit(1 << bits) + low).cast("double") / F.lit(float(10**scale))


def coefficient_of_variation(values: Column | str) -> Column:
    return ratio(F.stddev_samp(_c(values)), F.avg(_c(values)))


def money(col: Column | str, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(col), digits))


def percent(col: Column | str, digits: int = 1) -> Column:
    return F.concat(F.format_number(_c(col), digits), F.lit("%"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation over the complete pairs, NULL when a side does not vary."""
    a, b = _c(x), _c(y)
    known = a.isNotNull() & b.isNotNull()
    a, b = F.when(known, a), F.when(known, b)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
