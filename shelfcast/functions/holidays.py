"""Holidays by name as date expressions, and the weeks they fall into."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_day(month: int, day: int):
    """The same date every year."""
    return lambda year: F.make_date(year, F.lit(month), F.lit(day))


def nth_weekday(month: int, weekday: int, nth: int):
    """The nth weekday of a month (Monday is 0); the last one for ``nth`` of -1."""
    def rule(year: Column) -> Column:
        if nth > 0:
            first = F.make_date(year, F.lit(month), F.lit(1))
            return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))
        last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
        return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))

    return rule


def after_easter(days: int):
    """A number of days after Easter Sunday of the Gregorian calendar: the Sunday after the first full moon of spring."""
    def rule(year: Column) -> Column:
        century = F.floor(year / 100)
        leaps = F.floor(century / 4)
        drift = F.floor((century * 8 + 13) / 25)
        moon = F.pmod((year % 19) * 19 + century - leaps - drift + 15, F.lit(30))
        # Two late moons are put a day earlier, so that no cycle of 19 years has the same one twice.
        moon = moon - F.when((moon == 29) | ((moon == 28) & (year % 19 > 10)), 1).otherwise(0)
        full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
        return F.date_add(full, (F.lit(7) - F.pmod(F.weekday(full) + 1, F.lit(7))).cast("int") + days)

    return rule


#: Federal holidays of the United States and the first year of a young one.
US_HOLIDAYS = {
    "New Year's Day": fixed_day(1, 1),
    "Martin Luther King Jr. Day": nth_weekday(1, 0, 3),
    "Washington's Birthday": nth_weekday(2, 0, 3),
    "Memorial Day": nth_weekday(5, 0, -1),
    "Juneteenth": fixed_day(6, 19),
    "Independence Day": fixed_day(7, 4),
    "Labor Day": nth_weekday(9, 0, 1),
    "Columbus Day": nth_weekday(10, 0, 2),
    "Veterans Day": fixed_day(11, 11),
    "Thanksgiving": nth_weekday(11, 3, 4),
    "Christmas Day": fixed_day(12, 25),
}
SINCE = {"Juneteenth": 2021}


def holidays_of_weeks(weeks: DataFrame, date: str = "Date", rules: Mapping = US_HOLIDAYS, days_before: int = 0) -> DataFrame:
    """date, Holiday, Day: every holiday that falls into the seven days from ``days_before`` days before each distinct date.

    0 reads dates as the first day of their week, 6 as the last one.
    """
    first = F.date_sub(F.col(date), days_before)
    years = weeks.select(date).where(F.col(date).isNotNull()).distinct()
    years = years.select(date, first.alias("_first"), F.explode(F.array_distinct(F.array(F.year(first), F.year(F.date_add(first, 6))))).alias("_year"))
    named = years.select(date, "_first", F.inline(F.array(*[
        F.struct(F.lit(n).alias("Holiday"), F.when(F.col("_year") >= SINCE.get(n, 0), rule(F.col("_year"))).alias("Day")) for n, rule in rules.items()
    ]).cast("array<struct<Holiday:string,Day:date>>")))
    return named.where(F.datediff("Day", "_first").between(0, 6)).select(date, "Holiday", "Day")
