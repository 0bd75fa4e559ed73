import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_fact
from shelfcast.functions.ttest import two_sided_p
from shelfcast.operators import features, outliers, profile


def flat(n, level=100.0):
    return [(level, 0, 0.0)] * n


def test_history_gates(spark):
    fact = make_fact(spark, {(1, n): flat(n) for n in (1, 49, 50, 99, 100)})
    got = {r.Dept: r for r in profile.classify_all(fact).collect()}
    assert got[1].Recommended == got[49].Recommended == "NAIVE (Insufficient Data)"
    assert got[49].Confidence == 0.0
    assert {r.Dept for r in profile.series_metrics(fact).collect()} == {50, 99, 100}
    # 99 weeks: naive +2 for little data; learned +2 stable, +1 few zeros. 100 weeks: learned 5 of 5 points.
    assert got[99].Recommended == "ENSEMBLE" and got[99].Confidence == 0.5
    assert got[100].Recommended == "XGBOOST" and got[100].Confidence == 1.0


def test_all_zero_series_has_no_variation_and_neutral_ratios(spark):
    row = profile.series_metrics(make_fact(spark, {(1, 1): flat(60, 0.0)})).first()
    assert row.CV is None and row.ZeroPct == 100.0
    assert (row["HolidayLift%"], row.SeasonalRatio, row.TrendStrength, row["PromoLift%"]) == (0.0, 1.0, 0.0, 0.0)


def test_no_holiday_rows_and_all_weeks_promoted(spark):
    row = profile.series_metrics(make_fact(spark, {(1, 1): [(10.0 + i, 0, 1.0) for i in range(60)]})).first()
    assert row["HolidayLift%"] is None  # no holiday mean: unknown, as a missing numerator
    assert row["PromoLift%"] == 0.0  # no unpromoted mean to compare with


def test_metrics_against_plain_python(spark):
    rng = random.Random(3)
    values = [(rng.uniform(0, 100) * (3 if i % 13 == 0 else 1), int(i % 13 == 0), float(i % 4 == 0)) for i in range(120)]
    fact = make_fact(spark, {(1, 1): values})
    row = profile.series_metrics(fact.repartition(5)).first()
    y = np.array([v[0] for v in values])
    hol, promo = np.array([v[1] == 1 for v in values]), np.array([v[2] > 0 for v in values])
    assert row["HolidayLift%"] == pytest.approx((y[hol].mean() / y[~hol].mean() - 1) * 100)
    assert row["PromoLift%"] == pytest.approx((y[promo].mean() / y[~promo].mean() - 1) * 100)
    assert row.CV == pytest.approx(y.std(ddof=1) / y.mean())
    assert row.TrendStrength == pytest.approx(abs(np.polyfit(np.arange(120), y, 1)[0]) / y.mean() * 100)


@pytest.mark.parametrize("metrics,want", [
    (dict(lift=60.0, season=2.5, cv=0.9, zeros=20.0, n=60, promo=40.0, trend=0.0), ("NAIVE", 1.0)),
    (dict(lift=30.0, season=1.0, cv=0.2, zeros=0.0, n=143, promo=0.0, trend=2.0), ("XGBOOST", 1.0)),
    (dict(lift=60.0, season=1.0, cv=0.6, zeros=0.0, n=143, promo=0.0, trend=0.0), ("ENSEMBLE", 0.5)),
    (dict(lift=None, season=None, cv=None, zeros=5.0, n=143, promo=None, trend=None), ("XGBOOST", 1.0)),
])
def test_recommendation_rules(spark, metrics, want):
    df = spark.createDataFrame(
        [(metrics["lift"], metrics["season"], metrics["cv"], metrics["zeros"], metrics["n"], metrics["promo"], metrics["trend"])],
        "`HolidayLift%` double, SeasonalRatio double, CV double, ZeroPct double, DataPoints bigint, `PromoLift%` double, TrendStrength double",
    )
    row = profile.recommend(df).first()
    assert (row.Recommended, row.Confidence) == want


def test_diagnosis_order(spark):
    df = spark.createDataFrame(
        [(1, 10.0, 30.0, 5, 5, 20.0), (2, 10.0, 5.0, 6, 10, 20.0), (3, 10.0, 15.0, 0, 10, 120.0), (4, 10.0, 1.0, 0, 10, 12.0)],
        "Dept int, Mean double, Std double, ZeroWeeks int, Weeks int, Max double",
    )
    got = [r.Diagnosis for r in profile.diagnose_volatility(df).orderBy("Dept").collect()]
    assert got[:3] == ["EXTREME VOLATILITY", "INTERMITTENT DEMAND", "EXTREME SPIKES"]


def test_holiday_rule_needs_known_holiday_mean(spark):
    fact = make_fact(spark, {(1, 1): flat(60), (1, 2): [(300.0 if i % 10 == 0 else 100.0, int(i % 10 == 0), 0.0) for i in range(60)]})
    got = {r.Dept: r for r in profile.holiday_rule(fact).collect()}
    assert not got[1].IsHolidayDept and got[1].Recommended_Model == "XGBoost"
    assert got[2].IsHolidayDept and got[2]["HolidayLift%"] == pytest.approx(200.0)


def test_z_score_of_constant_and_single_row_series_is_zero(spark):
    fact = make_fact(spark, {(1, 1): flat(5), (1, 2): flat(1)})
    assert {r.z for r in features.z_score(fact, {"Weekly_Sales": "z"}).collect()} == {0.0}


def test_calendar_fill_adds_zero_weeks(spark):
    fact = make_fact(spark, {(1, 1): flat(5)}).where("Date <> date'2010-02-19'").select("Store", "Dept", "Date", "Weekly_Sales")
    filled = features.fill_calendar(fact)
    assert filled.count() == 5 and filled.where("Weekly_Sales = 0").count() == 1


# Published two-sided critical values of Student's t.
@pytest.mark.parametrize("t,dof,p", [
    (12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (1.980, 120, 0.05), (2.617, 120, 0.01), (0.0, 7, 1.0),
])
def test_t_tail_against_published_table(t, dof, p):
    assert two_sided_p(t, dof) == pytest.approx(p, abs=2e-4)


def test_t_tail_of_the_undefined():
    assert math.isnan(two_sided_p(float("nan"), 5)) and math.isnan(two_sided_p(1.0, 0))


def test_ttest_skips_series_without_both_kinds(spark):
    fact = make_fact(
        spark,
        {(1, 1): flat(30) + [(1000.0, 0, 0.0)], (1, 2): flat(30)},
        lambda s, d, i: (float(i % 7), 3.0, 200.0 + i, 8.0),
    )
    rows = outliers.factor_ttest(outliers.weekly_outliers(fact)).collect()
    assert {r.Dept for r in rows} == {1} and len(rows) == 4
    by = {r.Feature: r for r in rows}
    assert by["Fuel_Price"].T_Statistic is None and by["Fuel_Price"].P_Value is None  # no spread at all
    a, b = np.array([230.0]), 200.0 + np.arange(30)
    pooled = (29 * b.var(ddof=1)) / 29
    assert by["CPI"].T_Statistic == pytest.approx((a.mean() - b.mean()) / math.sqrt(pooled * (1 + 1 / 30)))


def test_cause_rules_first_match_wins(spark):
    cols = "Store int, Dept int, Date date, IsHoliday int, Fuel_Price_Z double, CPI_Z double, Unemployment_Z double, Temperature_Z double, Is_Weekly_Outlier boolean"
    import datetime as dt

    nov, may = dt.date(2010, 11, 5), dt.date(2010, 5, 7)
    rows = [
        (1, 1, nov, 1, 3.0, 3.0, 3.0, 3.0, True),
        (1, 2, nov, 0, -3.0, 3.0, 3.0, 3.0, True),
        (1, 3, nov, 0, 0.0, 3.0, 3.0, 3.0, True),
        (1, 4, nov, 0, 0.0, 0.0, -3.0, 3.0, True),
        (1, 5, nov, 0, 0.0, 0.0, 0.0, 3.0, True),
        (1, 6, may, 0, 0.0, 0.0, 0.0, 3.0, True),
        (1, 7, may, 0, 2.0, None, 0.0, 0.0, True),
        (1, 8, may, 1, 3.0, 3.0, 3.0, 3.0, False),
    ]
    got = [r.Cause for r in outliers.label_causes(spark.createDataFrame(rows, cols)).orderBy("Dept").collect()]
    assert got == [
        "Holiday-Driven", "Fuel_Price Shock", "CPI Shock", "Unemployment Shock", "Seasonal Peak", "Temperature Extreme", "Unknown",
    ]


def test_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbc"], "Cause string").withColumn("Store", F.lit(1)).withColumn("Dept", F.lit(1))
    rows = outliers.cause_distribution(df).collect()
    assert sum(r.Percentage for r in rows) == pytest.approx(100)
    assert outliers.cause_distribution(df, stores=[9]).collect() == []
