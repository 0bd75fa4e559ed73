import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import make_fact, weeks
from shelfcast.operators import baselines, combine, evaluate, features, inventory

TRAIN_END, VAL_END = "2011-06-01", "2012-01-01"


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(0)
    series = {(1, d): [(float(v), 0, 0.0) for v in rng.uniform(10, 100, 143)] for d in (1, 2)}
    return features.label_split(make_fact(spark, series), TRAIN_END, VAL_END)


def as_pandas(split, dept):
    pdf = split.where(F.col("Dept") == dept).toPandas().sort_values("Date")
    return pdf[pdf.split == "train"], pdf[pdf.split == "val"], pdf[pdf.split == "test"]


def test_baselines_against_pandas(split):
    got = baselines.baseline_forecasts(split).toPandas()
    for dept in (1, 2):
        train, _, test = as_pandas(split, dept)
        y = test.Weekly_Sales
        want = {
            "Naive": y.shift(1).fillna(train.Weekly_Sales.iloc[-1]),
            "Simple Average": pd.Series(train.Weekly_Sales.mean(), index=y.index),
            "Seasonal Naive": y.shift(52).ffill().fillna(train.Weekly_Sales.mean()),
        }
        for model, values in want.items():
            mine = got[(got.Dept == dept) & (got.Model == model)].sort_values("Date").Predicted
            np.testing.assert_allclose(mine.to_numpy(), values.to_numpy())


def test_bridge_and_full_history(split):
    train, val, test = as_pandas(split, 1)
    naive = baselines.baseline_forecasts(split, models=("Naive",), bridge="val").where("Dept = 1").orderBy("Date").first()
    assert naive.Predicted == val.Weekly_Sales.iloc[-1]
    whole = pd.concat([train, val, test]).Weekly_Sales
    seasonal = baselines.baseline_forecasts(split, models=("Seasonal Naive",), history="full")
    mine = [r.Predicted for r in seasonal.where("Dept = 1").orderBy("Date").collect()]
    np.testing.assert_allclose(mine, whole.shift(52).iloc[-len(test):])


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 12.0), (1, 1, 30.0, 26.0), (1, 1, 20.0, None)], "Store int, Dept int, Actual double, Predicted double")
    row = evaluate.error_metrics(df.withColumn("Model", F.lit("m"))).first()
    assert (row.MAE, row.MAPE, row.Weeks) == (3.0, 15.0, 2)
    assert row.RMSE == pytest.approx(np.sqrt(10))
    q = evaluate.regression_quality(df).first()
    assert q.MAPE_True == pytest.approx((0.2 + 4 / 30) / 2) and q.R2 == pytest.approx(1 - 20 / 200)


def results(spark, rows):
    return spark.createDataFrame(rows, "Store int, Dept int, Store_Type string, Model string, MAE double, MAPE double, Avg_Sales double")


def test_equal_errors_go_by_model_order(spark):
    r = results(spark, [
        (1, 1, "A", "Ensemble", 1.0, 10.0, 10.0), (1, 1, "A", "XGBoost", 1.0, 10.0, 10.0), (1, 1, "A", "Naive", 1.0, 10.0, 10.0),
        (1, 2, "A", "Naive", 3.0, 30.0, 10.0), (1, 2, "A", "Other", 2.0, 20.0, 10.0), (1, 2, "A", "Random Forest", 2.0, 20.0, 10.0),
        (1, 3, "A", "Naive", 1.0, None, 0.0),
    ])
    best = {x.Dept: x.Model for x in evaluate.best_models(r).collect()}
    assert best == {1: "Naive", 2: "Random Forest"}
    compared = {x.Dept: x for x in evaluate.naive_vs_best(r).collect()}
    assert compared[1].Naive_Wins and not compared[2].Naive_Wins
    assert compared[2].Improvement_Needed == pytest.approx(50.0)
    assert evaluate.naive_wins_by_min(r).first().Naive_Wins == 1
    k = evaluate.headline_kpis(r).first()
    assert (k.Best_Dept, k.Worst_Dept, k.Avg_MAPE, k.Best_Avg_MAPE) == (1, 2, 20.0, 15.0)


def test_best_error_is_never_above_any_model(split, spark):
    stores = spark.createDataFrame([(1, "A", 10)], "Store int, Type string, Size int")
    table = evaluate.league_table(baselines.baseline_forecasts(split, history="full"), stores)
    best = evaluate.best_models(table).select("Store", "Dept", F.col("MAPE").alias("b"))
    assert table.join(best, ["Store", "Dept"]).where("b > MAPE").count() == 0


def test_impact_edges_and_empty_bins(spark):
    r = results(spark, [(1, d, "A", "Naive", 1.0, 10.0, 10.0) for d in range(1, 7)])
    sales = spark.createDataFrame([(1, d, 100.0) for d in range(1, 7)], "Store int, Dept int, Weekly_Sales double")
    profile = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.3), (1, 3, 0.6), (1, 4, 1.0), (1, 5, 0.31)], "Store int, Dept int, CV double")
    impact = inventory.inventory_impact(r, sales, profile)
    by = {x.Dept: x for x in impact.collect()}
    assert by[6].CV == 0.5 and by[6].Under_Forecast_Pct == pytest.approx(0.5)
    assert by[1].Under_Forecast_Pct == pytest.approx(0.3) and by[4].Under_Forecast_Pct == pytest.approx(0.7)
    assert by[1].Error_Dollars == pytest.approx(520.0)
    assert by[1].Total_Impact == pytest.approx(520 * 0.3 * 0.25 * 2 + 520 * 0.7 * 0.25)
    bins = {x.Volatility: x.Dept_Count for x in inventory.impact_by_volatility(impact).collect()}
    assert bins == {"Low": 1, "Medium": 3, "High": 1, "Very High": 0}  # CV 0 is in no bin


def test_improvement_potential_by_hand(spark):
    r = results(spark, [
        (1, 1, "A", "Naive", 1.0, 10.0, 10.0), (1, 1, "A", "Ensemble", 1.0, 4.0, 10.0), (1, 2, "A", "Naive", 1.0, 5.0, 10.0),
        (1, 2, "A", "Ensemble", 1.0, 6.0, 10.0), (1, 3, "A", "Ensemble", 1.0, 6.0, 10.0), (None, 4, "A", "Naive", 1.0, 6.0, 10.0),
    ])
    sales = spark.createDataFrame([(1, 1, 50.0), (1, 1, 150.0), (1, 2, 200.0), (1, 3, 100.0), (None, 4, 100.0)], "Store int, Dept int, Weekly_Sales double")
    got = {x.Dept: x for x in inventory.improvement_potential(r, sales).collect()}
    assert sorted(got) == [1, 2]  # no naive forecast in 3, no store in 4
    assert (got[1].MAPE_Naive, got[1].MAPE_Best, got[2].MAPE_Naive, got[2].MAPE_Best) == (10.0, 4.0, 5.0, 5.0)
    assert (got[1].Current_Error, got[1].Best_Error, got[1].Potential_Savings) == pytest.approx((520.0, 208.0, 312.0))
    assert got[2].Potential_Savings == 0.0


def test_next_week_forecast_labels(spark):
    scenarios = spark.createDataFrame([(1, 1, 100.0, True), (1, 2, 100.0, True), (1, 3, 100.0, False)], "Store int, Dept int, Base_Value double, Holiday_Next boolean")
    profile = spark.createDataFrame(
        [(1, 1, "NAIVE", 1.0, 0.9, 50.0), (1, 2, "ENSEMBLE", 0.5, 0.5, 30.0), (1, 3, "NAIVE", 1.0, 0.1, 80.0)],
        "Store int, Dept int, Recommended string, Confidence double, CV double, `HolidayLift%` double",
    )
    got = {r.Dept: r for r in baselines.next_week_forecast(scenarios, profile).collect()}
    assert got[1].Predicted == 150.0 and got[1].Method == "Holiday Adjusted (+50.0%)" and got[1].Holiday_Alert
    assert got[2].Predicted == 100.0 and got[2].Method == "XGBoost" and not got[2].Holiday_Alert
    assert got[3].Method == "Naive Forecast (last week)" and got[3].Confidence_Level == "High"


def test_forecast_point_and_future_weeks(spark, split):
    forecast = spark.createDataFrame([(1, 1, 7.0)], "Store int, Dept int, Predicted double")
    out = baselines.history_with_forecast(split.where("Dept = 1"), forecast)
    last = weeks(143)[-1]
    point = out.where("Type = 'Forecast'").first()
    assert point.Date == last + dt.timedelta(days=7) and out.count() == 144
    ahead = [r.Date for r in features.future_weeks(split, 3).where("Dept = 2").orderBy("step").collect()]
    assert ahead == [last + dt.timedelta(days=7 * k) for k in (1, 2, 3)]


def test_rolling_mean_needs_four_known_weeks(spark):
    values = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0]
    fact = make_fact(spark, {(1, 1): [(v, 0, 0.0) for v in values], (1, 2): [(9.0, 0, 0.0)]})
    rows = features.lag_features(fact).where("Dept = 1").orderBy("Date").collect()
    assert [r.Rolling_Mean_4 for r in rows] == [None] * 7 + [5.5]
    assert rows[4].Lag_4 == 1.0
    assert features.lag_features(fact).where("Dept = 2").first().Lag_1 is None


def test_top_k_per_group_and_tie_order(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(9)], "g string, i int, v double")
    got = [(r.i, r.rank) for r in combine.top_k_per_group(df, ("g",), "v", 2, ("i",)).orderBy("rank").collect()]
    assert got == [(2, 1), (5, 2)]
