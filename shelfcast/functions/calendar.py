"""Date expressions on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col: Column | str, fmt: str | None = None, strict: bool = True) -> Column:
    """ISO dates by default, any other layout by pattern; ``strict=False`` turns dirty text into NULL."""
    args = (_c(col),) if fmt is None else (_c(col), fmt)
    return F.to_date(*args) if strict else F.try_to_date(*args)


def weekday_from_monday(col: Column | str) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(col))


def iso_week(col: Column | str) -> Column:
    return F.weekofyear(_c(col))


def week_monday(col: Column | str) -> Column:
    return F.trunc(_c(col), "week")


def week_sunday(col: Column | str) -> Column:
    """The Sunday on or before the date: the unambiguous name of a Sunday-based week."""
    c = _c(col)
    return F.date_sub(c, F.dayofweek(c) - 1)


def year_week(col: Column | str) -> Column:
    """Year plus Sunday-based week number; days before the first Sunday are week 00."""
    c = _c(col)
    week = F.floor((F.dayofyear(c) + 7 - F.dayofweek(c)) / 7)
    return F.concat(F.year(c).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def period_start(col: Column | str, unit: str) -> Column:
    c = _c(col)
    return c if unit == "day" else F.trunc(c, unit)


def period_label(start: Column | str, unit: str) -> Column:
    """Label of a period given its first day: a day, ``first/last`` of a Monday week, or a month."""
    c = _c(start)
    if unit == "day":
        return F.date_format(c, "yyyy-MM-dd")
    if unit == "week":
        return F.concat_ws("/", F.date_format(c, "yyyy-MM-dd"), F.date_format(F.date_add(c, 6), "yyyy-MM-dd"))
    if unit == "month":
        return F.date_format(c, "yyyy-MM")
    raise ValueError(f"unknown period unit {unit!r}")


def month_name(month: Column | str) -> Column:
    """Short English name of a month number, independent of the session locale."""
    # Fixed values.
    names = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), _c(month).cast("int"))


def holiday_season(col: Column | str) -> Column:
    """November and December."""
    return F.month(_c(col)).isin(11, 12)
