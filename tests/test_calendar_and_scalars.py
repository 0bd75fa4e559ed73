import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions import scalars


def test_year_week_matches_strftime_over_years(spark):
    start = dt.date(2009, 12, 20)
    days = [(start + dt.timedelta(days=i),) for i in range(1500)]
    rows = spark.createDataFrame(days, "d date").select(
        "d", cal.year_week("d").alias("yw"), cal.week_sunday("d").alias("s"), cal.weekday_from_monday("d").alias("w"),
        cal.iso_week("d").alias("iso"),
    ).collect()
    for r in rows:
        assert r.yw == r.d.strftime("%Y-%U")
        assert r.s == r.d - dt.timedelta(days=(r.d.weekday() + 1) % 7)
        assert r.w == r.d.weekday()
        assert r.iso == r.d.isocalendar()[1]


def test_dates_of_two_layouts_and_dirty_text(spark):
    df = spark.createDataFrame([("2011-06-01", "01/06/2011", "oops")], "a string, b string, c string")
    row = df.select(
        cal.parse_date("a").alias("a"),
        cal.parse_date("b", "dd/MM/yyyy").alias("b"),
        cal.parse_date("c", "dd/MM/yyyy", strict=False).alias("c"),
    ).first()
    assert row.a == row.b == dt.date(2011, 6, 1)
    assert row.c is None


@pytest.mark.parametrize("unit,label", [
    ("day", "2010-02-05"), ("week", "2010-02-01/2010-02-07"), ("month", "2010-02"),
])
def test_period_labels(spark, unit, label):
    df = spark.createDataFrame([(dt.date(2010, 2, 5),)], "d date")
    assert df.select(cal.period_label(cal.period_start("d", unit), unit).alias("p")).first().p == label


def test_clip_keeps_null_and_ratio_survives_zero(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.5, 0.0), (0.9, None), (None, 2.0)], "a double, b double")
    rows = df.select(scalars.clip("a", 0.3, 0.7).alias("c"), scalars.ratio("a", "b").alias("r")).collect()
    assert [r.c for r in rows] == [0.3, 0.5, 0.7, None]
    assert [r.r for r in rows] == [0.1, None, None, None]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    assert [r[0] for r in df.select(scalars.round_half_even("x", 2)).collect()] == [0.12, 0.38, 2.5]


def test_exact_total_of_large_and_negative_units(spark):
    units = [(1, 2**62), (1, 2**62), (1, 2**62), (2, -5), (2, 3), (2, None)]
    rows = spark.createDataFrame(units, "k int, u bigint").groupBy("k").agg(
        scalars.exact_total("u", 2).alias("t")
    ).collect()
    got = {r.k: r.t for r in rows}
    assert got[1] == float(3 * 2**62) / 100
    assert got[2] == -0.02


def test_month_names(spark):
    df = spark.range(1, 13).select(cal.month_name("id").alias("m"))
    assert [r.m for r in df.collect()] == "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
