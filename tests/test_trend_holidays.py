import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_fact, weeks
from shelfcast.functions import holidays as H
from shelfcast.operators import features, trend_holidays


def test_holidays_fall_on_known_days(spark):
    days = spark.createDataFrame([(dt.date(2011, 1, 3) + dt.timedelta(days=7 * i),) for i in range(-1, 52)], "Date date")
    rules = {**H.US_HOLIDAYS, "Easter Sunday": H.after_easter(0), "Good Friday": H.after_easter(-2)}
    found = {r.Holiday: r.Day for r in H.holidays_of_weeks(days, rules=rules).collect() if r.Day.year == 2011}
    d = lambda m, k: dt.date(2011, m, k)
    assert found == {
        "New Year's Day": d(1, 1), "Martin Luther King Jr. Day": d(1, 17), "Washington's Birthday": d(2, 21), "Memorial Day": d(5, 30),
        "Independence Day": d(7, 4), "Labor Day": d(9, 5), "Columbus Day": d(10, 10), "Veterans Day": d(11, 11), "Thanksgiving": d(11, 24),
        "Christmas Day": d(12, 25), "Easter Sunday": d(4, 24), "Good Friday": d(4, 22),
    }
    last = H.holidays_of_weeks(spark.createDataFrame([(dt.date(2011, 11, 25),), (None,)], "Date date"), days_before=6).collect()
    assert [(r.Date, r.Holiday) for r in last] == [(dt.date(2011, 11, 25), "Thanksgiving")]
    assert {r.Holiday for r in H.holidays_of_weeks(spark.createDataFrame([(dt.date(2022, 6, 13),), (dt.date(2012, 6, 18),)], "Date date")).collect()} == {"Juneteenth"}


def test_easter_over_the_years(spark):
    known = {1954: (4, 18), 1961: (4, 2), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25), 2049: (4, 18), 2076: (4, 19)}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select("y", H.after_easter(0)(F.col("y")).alias("d")).collect()
    assert {r.y: (r.d.month, r.d.day) for r in rows} == known


@pytest.fixture(scope="module")
def planted(spark):
    """Series 1: the slope turns after 60 weeks and Thanksgiving weeks sell half more; series 2: straight; series 3: short."""
    rng = np.random.default_rng(4)
    days = weeks(143)
    thanks = {dt.date(2010, 11, 25), dt.date(2011, 11, 24), dt.date(2012, 11, 22)}
    hit = np.array([any(d <= t < d + dt.timedelta(days=7) for t in thanks) for d in days])
    i = np.arange(143)
    angle = 2 * np.pi * i * 7 / 365.25
    bent = 5 + 0.004 * i - 0.016 * np.maximum(i - 60, 0) + 0.1 * np.sin(angle) + np.log(1.5) * hit + rng.normal(0, 0.01, 143)
    plain = 5 + 0.004 * i + 0.1 * np.sin(angle) + rng.normal(0, 0.01, 143)
    series = {(1, 1): bent, (1, 2): plain, (1, 3): plain[:30]}
    fact = make_fact(spark, {k: [(float(np.exp(v)), 0, 0.0) for v in vs] for k, vs in series.items()})
    return features.label_split(fact, "2012-07-01", "2012-07-01").where("Dept <> 3 or Date >= '2010-06-01'").cache()


def test_planted_kink_and_holiday_are_recovered(planted):
    fits = {r.Dept: r for r in trend_holidays.trend_fits(planted).collect()}
    bent, plain = fits[1], fits[2]
    assert bent.Gap < 1e-3 and plain.Gap < 1e-3
    slopes = lambda r: np.concatenate([[r.Slope], r.Slope + np.cumsum(r.Changes)])
    early, late = slopes(bent)[3], slopes(bent)[-1]
    assert early == pytest.approx(0.004 * 365.25 / 7, abs=0.05) and late == pytest.approx(-0.012 * 365.25 / 7, abs=0.08)
    turn = np.array(bent.Changes)
    near = np.array([abs((d - weeks(143)[60]).days) <= 42 for d in bent.Change_Days])
    assert turn[near].sum() == pytest.approx(-0.016 * 365.25 / 7, rel=0.15)
    assert np.ptp(slopes(plain)) < 0.1
    assert bent.Effects["Thanksgiving"] == pytest.approx(np.log(1.5), abs=0.05)
    assert all(abs(v) < 0.06 for n, v in bent.Effects.items() if n != "Thanksgiving") and "Juneteenth" not in bent.Effects
    assert all(abs(v) < 0.06 for v in plain.Effects.values())
    for r in (bent, plain):
        np.testing.assert_allclose(r.Predicted, r.Actual, rtol=0.08)


def test_short_series_and_empty_tables(planted):
    rows = trend_holidays.trend_fits(planted.where("Dept = 3 and split = 'train' or Dept = 1"), least=20).collect()
    short = next(r for r in rows if r.Dept == 3)
    assert short.Status == "too short" and short.Slope is None and short.Effects is None and short.Predicted == []
    assert trend_holidays.trend_fits(planted.limit(0)).count() == 0
    fits = trend_holidays.trend_fits(planted.where("Dept <> 3"), rules={}, days_before=6)
    assert trend_holidays.trend_forecast(fits).count() == planted.where("split = 'test'").count()
