import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_fact
from shelfcast.operators import explain, features, learners, series_trees, uplift
from shelfcast.operators.series_fit import (
    arima_forecast, enough_for_arima, fit_arma, forecast_arima, forecast_trend_season, seasonal_arima_forecast, trend_season_forecast,
)
from shelfcast.sources import sinks

SMALL = learners.Boosting(8, 3, 0.3)


@pytest.fixture(scope="module")
def parts(spark):
    """Sales driven by temperature alone; department 2 has no holidays and sells twice as much."""
    rng = np.random.default_rng(5)
    temps = {(1, d): rng.uniform(0, 100, 143) for d in (1, 2, 3)}
    series = {
        k: [(float(t * k[1] + 20), int(i % 13 == 0), float(i % 5 == 0)) for i, t in enumerate(ts)] for k, ts in temps.items()
    }
    fact = make_fact(spark, series, lambda s, d, i: (float(temps[(s, d)][i]), 3.0, None if i == 7 else 200.0, 8.0))
    return features.label_split(fact, "2011-06-01", "2012-01-01").cache()


@pytest.fixture(scope="module")
def model(parts):
    return learners.fit_boosting(parts.where("split = 'train'"), settings=learners.Boosting(20, 4, 0.3))


def test_boosting_learns_and_keeps_the_input(parts, model):
    test = parts.where("split = 'test'")
    scored = learners.score(model, test)
    assert scored.columns == [*test.columns, "Predicted"]
    assert dict(scored.dtypes)["Store"] == "int"
    err = scored.agg(F.avg(F.abs(F.col("Weekly_Sales") - F.col("Predicted"))) / F.avg("Weekly_Sales")).first()[0]
    assert err < 0.2
    assert learners.score(model, parts).where("CPI is null").count() == 3  # filled for the model only


def test_same_seed_same_model(parts, model):
    again = learners.fit_boosting(parts.where("split = 'train'"), settings=learners.Boosting(20, 4, 0.3))
    a = learners.score(model, parts).agg(F.sum("Predicted")).first()[0]
    assert a == learners.score(again, parts).agg(F.sum("Predicted")).first()[0]


def test_early_stop_uses_validation_rows(parts):
    settings = learners.Boosting(40, 3, 0.5, early_stop=True)
    stopped = learners.fit_boosting(parts.where("split <> 'test'"), settings=settings)
    assert 1 <= stopped.stages[-1].getNumTrees <= 40


def test_patience_decides_how_many_trees_stay():
    errors = [9, 5, 6, 6, 6, 4, 7, 7, 7]
    assert [learners.best_prefix(errors, p) for p in (2, 3, 4, 20)] == [2, 2, 6, 6]


def test_stores_and_departments_get_their_own_bins(spark):
    rows = spark.range(400).select((F.col("id") % 50).alias("Store"), (F.col("id") % 7).alias("Dept"))
    assert learners.bins_for(rows, ["Store", "Dept"]) == 51
    assert learners.bins_for(rows, ["Dept"]) == 32


def test_series_boosting_follows_plain_arithmetic():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    y = np.array([0.0, 0.0, 10.0, 10.0])
    out, trees, gains = series_trees.boost(x, y, learners.Boosting(1, 1, 0.5), None, [x])
    # Mean 5; residual sums of -10 and 10 over 2 rows and a ridge of 1, half a step.
    np.testing.assert_allclose(out[0], [5 - 5 / 3] * 2 + [5 + 5 / 3] * 2)
    assert trees == 1 and gains[0] == pytest.approx(2 * 100 / 3)
    for settings in (learners.Boosting(60, 3, 0.3), learners.Boosting(60, 3, 0.3, 0.8, 0.8)):
        rng = np.random.default_rng(0)
        x = rng.normal(size=(200, 4))
        y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 5, 0)
        out, _, gains = series_trees.boost(x[:150], y[:150], settings, None, [x[150:]])
        assert np.mean((out[0] - y[150:]) ** 2) < 0.15 * np.var(y) and gains[:2].min() > gains[2:].max()


def test_series_patience_changes_the_trees_kept():
    rng = np.random.default_rng(3)
    x, val = rng.normal(size=(60, 3)), rng.normal(size=(40, 3))
    y, y_val = x[:, 0] + rng.normal(0, 2, 60), val[:, 0] + rng.normal(0, 2, 40)
    kept = [series_trees.boost(x, y, learners.Boosting(200, 3, 0.1, early_stop=True, patience=p), (val, y_val), [])[1] for p in (1, 20)]
    assert 1 <= kept[0] <= kept[1] < 200
    errors = []
    for k in range(1, kept[1] + 21):
        out, _, _ = series_trees.boost(x, y, learners.Boosting(k, 3, 0.1), None, [val])
        errors.append(np.mean((out[0] - y_val) ** 2))
    assert learners.best_prefix(errors, 20) == kept[1]


def test_series_forest_is_a_mean_inside_the_range():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = np.where(x[:, 0] > 0, 10.0, 0.0)
    out, trees, _ = series_trees.forest(x, y, learners.Forest(30, 10), [x, rng.normal(size=(50, 2)) * 9])
    assert trees == 30 and np.mean((out[0] > 5) == (y > 5)) > 0.97
    assert out[1].min() >= 0 and out[1].max() <= 10


def test_series_models_predict_every_test_week(parts):
    models = {"XGBoost": SMALL, "Random Forest": learners.Forest(5, 4)}
    rows = series_trees.series_models(parts, models, ensemble="Ensemble").collect()
    assert len(rows) == 3 * parts.where("split = 'test'").count()
    by = {}
    for r in rows:
        by.setdefault((r.Dept, r.Date), {})[r.Model] = r.Predicted
    assert all(v["Ensemble"] == pytest.approx((v["XGBoost"] + v["Random Forest"]) / 2) for v in by.values())
    missing = series_trees.series_models(parts.where("split <> 'train' or Dept = 1"), {"XGBoost": SMALL}).collect()
    assert {r.Dept for r in missing if r.Predicted is None} == {2, 3} and {r.Trees for r in missing if r.Dept == 2} == {0}
    shares = series_trees.series_importance(parts, SMALL).collect()
    assert {(r.Dept, r.Feature) for r in shares if r.Importance > 0.5} == {(d, "Temperature") for d in (1, 2, 3)}


def test_a_model_that_watches_the_validation_part_is_not_fitted_on_it(parts):
    with pytest.raises(ValueError, match="validation part"):
        series_trees.series_models(parts, {"x": learners.Boosting(5, early_stop=True)}, fit_on=("train", "val"))


def test_the_gate_sees_errors_out_of_sample(parts):
    """A model that knows the validation part by heart passes the gate; the train-only fit of pure noise does not."""
    noise = parts.withColumn("Weekly_Sales", F.when(F.rand(1) < 0.5, 1.0).otherwise(200.0)).cache()
    deep = {"XGBoost": learners.Boosting(40, 8, 0.5)}
    gate = lambda fit_on: series_trees.series_models(noise, deep, fit_on=fit_on, predict_on=("val",)).groupBy("Dept").agg(
        (F.avg(F.abs(F.col("Actual") - F.col("Predicted"))) / F.avg("Actual") * 100).alias("MAPE")).collect()
    assert max(r.MAPE for r in gate(("train", "val"))) < 50 < min(r.MAPE for r in gate(("train",)))


def test_study_on_one_span(spark, parts):
    from shelfcast.plans.study import model_study

    stores = spark.createDataFrame([(1, "A", 1000)], "Store int, Type string, Size int")
    study = model_study(parts.drop("split"), stores, "2011-06-01", "2012-01-01", boosting=SMALL, forest=learners.Forest(5, 4), hybrid_boosting=SMALL, fit_on=("train", "val"))
    weeks = {r.Model: r["n"] for r in study["predictions"].groupBy("Model").agg(F.count("*").alias("n")).collect()}
    assert len(weeks) == 9 and len(set(weeks.values())) == 1
    assert study["results"].count() > 0 and study["importance"].select("Feature").distinct().count() == len(learners.MODEL_FEATURES)


def test_ensemble_is_the_mean(parts, model):
    forest = learners.fit_forest(parts.where("split = 'train'"), settings=learners.Forest(5, 4))
    test = parts.where("split = 'test'")
    key = ["Store", "Dept", "Date"]
    both = learners.average_of([model, forest], test).select(*key, F.col("Predicted").alias("m"))
    a = learners.predictions(model, test, "a").select(*key, F.col("Predicted").alias("a"))
    b = learners.predictions(forest, test, "b").select(*key, F.col("Predicted").alias("b"))
    row = both.join(a, key).join(b, key).agg(F.max(F.abs(F.col("m") - (F.col("a") + F.col("b")) / 2)), F.count("m")).first()
    assert row[0] < 1e-9 and row[1] == test.count()


def test_model_round_trip_scores_scenarios(spark, parts, model, tmp_path):
    sinks.save_model(model, str(tmp_path / "m"))
    loaded = sinks.load_pipeline(str(tmp_path / "m"))
    scenarios = spark.createDataFrame([(1, 2, 90.0, 3.0, 200.0, 8.0, True, 1000), (1, 2, 10.0, None, 200.0, 8.0, False, 1000)],
        "Store int, Dept int, Temperature double, Fuel_Price double, CPI double, Unemployment double, IsHoliday boolean, Size int")
    rows = learners.scenario_scores(loaded, scenarios).collect()
    assert rows[0].Predicted > rows[1].Predicted + 50


def hybrid(spark, parts, recommended, scale=1.0):
    scored = parts.where("split <> 'train'").withColumn("Predicted", F.col("Weekly_Sales") * scale)
    rows = [(1, d, r, 143) for d, r in enumerate(recommended, 1)]
    profile = spark.createDataFrame(rows, "Store int, Dept int, Recommended string, DataPoints int")
    return learners.hybrid_wide(parts, scored, profile)


def test_hybrid_follows_the_recommendation(spark, parts):
    wide = hybrid(spark, parts, ["NAIVE", "XGBOOST", "ENSEMBLE"], 1.1)
    used = {r.Dept: r for r in learners.hybrid_results(wide).collect()}
    assert [used[d].Model_Used for d in (1, 2, 3)] == ["NAIVE", "XGBOOST", "ENSEMBLE"]
    assert used[2].Final_MAPE == pytest.approx(10.0) and used[1].Final_MAPE == pytest.approx(used[1].Naive_MAPE)
    w = used[3].Naive_Weight
    assert 0 < w <= 0.9
    off = wide.where("Dept = 3").select(
        F.max(F.abs(F.col("Predicted") - (w * F.col("Naive") + (1 - w) * F.col("Actual") * 1.1)))
    ).first()[0]
    assert off < 1e-9


def test_hybrid_refuses_a_model_that_fails_validation(spark, parts):
    rows = learners.hybrid_results(hybrid(spark, parts, ["NAIVE", "XGBOOST", "ENSEMBLE"], 1.6)).collect()
    assert {r.Model_Used for r in rows} == {"NAIVE"} and {r.XGBoost_MAPE for r in rows} == {None}


def test_shapley_values_add_up(parts, model):
    test = parts.where("split = 'test'")
    used = learners.MODEL_FEATURES
    shap = explain.shapley_values(model, test, used, pairs=2)
    total = sum((F.col(f"Shap_{f}") for f in used[1:]), F.col(f"Shap_{used[0]}"))
    row = shap.agg(F.max(F.abs(total - (F.col("Predicted") - F.col("Baseline")))), F.count("Store"), F.avg(F.abs("Shap_Temperature"))).first()
    assert row[0] < 1e-6 and row[1] == test.count() and row[2] > 10
    assert shap.agg(F.max(F.abs("Shap_Fuel_Price"))).first()[0] == 0.0  # constant feature
    joined = explain.shapley_with_features(shap, test, used)
    assert joined.count() == test.count() and "Temperature" in joined.columns


def test_permutation_importance_finds_the_driver(parts, model):
    rows = explain.permutation_importance(model, parts.where("split = 'test'")).collect()
    by = {(r.Dept, r.Feature): r.Importance for r in rows}
    assert len(by) == 3 * len(learners.MODEL_FEATURES)
    for d in (1, 2, 3):
        assert by[(d, "Temperature")] > 0.9
        assert by[(d, "Dept")] == by[(d, "Size")] == 0.0
        assert sum(v for (k, _), v in by.items() if k == d) == pytest.approx(1.0)


def test_importance_tables(spark, parts, model):
    top = explain.model_importance(spark, model, learners.MODEL_FEATURES).first()
    assert top.Feature == "Temperature"
    df = spark.createDataFrame([(1, 1, f, v) for f, v in (("a", 0.5), ("b", 0.3), ("c", 0.2))], "Store int, Dept int, Feature string, Importance double")
    row = explain.importance_summary(df, 2).first()
    assert (row.Features, row.Top_Feature, row.Top_Importance) == (3, "a", 0.5) and row.Top_Share == pytest.approx(80)
    assert [r.Feature for r in explain.mean_importance(df, 2).collect()] == ["a", "b"]


def test_arma_search_recovers_parameters():
    rng = np.random.default_rng(2)
    e = rng.normal(size=4000)
    w = np.zeros(4000)
    for t in range(1, 4000):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.3 * e[t - 1]
    ar, ma = fit_arma(w)[:2]
    assert ar == pytest.approx(0.6, abs=0.08) and ma == pytest.approx(0.3, abs=0.08)


def test_forecasts_of_simple_series():
    np.testing.assert_allclose(forecast_arima(np.full(60, 5.0), 4), 5.0)
    assert np.isnan(forecast_arima(np.arange(9.0), 2)).all()
    t = np.arange(200)
    wave = 100 + 30 * np.sin(2 * np.pi * t / 52)
    np.testing.assert_allclose(forecast_arima(wave[:180], 20, 52), wave[180:], atol=0.5)
    assert np.isnan(forecast_arima(wave[:60], 3, 52)).all()
    days = t * 7.0
    season = 100 * np.exp(0.001 * t + 0.3 * np.sin(2 * np.pi * days / 365.25)) * np.where(t % 26 == 0, 1.5, 1.0)
    flag = (t % 26 == 0).astype(float)
    out = forecast_trend_season(days[:160], season[:160], flag[:160], days[160:], flag[160:])
    np.testing.assert_allclose(out, season[160:], rtol=0.05)
    for weeks, known in ((19, False), (20, True)):
        assert np.isnan(forecast_trend_season(days[:weeks], season[:weeks], flag[:weeks], days[160:], flag[160:])).all() != known
    capped = forecast_trend_season(days[:160], season[:160], flag[:160], days[160:], flag[160:], cap_factor=0.5)
    assert capped.max() == pytest.approx(season[:160].max() / 2)


@pytest.mark.parametrize(("weeks", "season", "fine"), [(9, 0, False), (10, 0, True), (124, 52, False), (125, 52, True)])
def test_least_histories(weeks, season, fine):
    y = 100 + 10 * np.sin(np.arange(weeks))
    assert enough_for_arima(weeks, season) == fine
    assert np.isnan(forecast_arima(y, 2, season)).all() != fine


def test_series_fits_return_every_test_week(parts):
    want = parts.where("split = 'test'").count()
    for fit in (arima_forecast, seasonal_arima_forecast, trend_season_forecast):
        rows = fit(parts).cache()
        assert rows.count() == want
        assert {r.Status for r in rows.collect()} <= {"ok", "too short"}
    # 69 training weeks are fewer than a season and 20 weeks.
    assert seasonal_arima_forecast(parts).where("Predicted is not null").count() == 0
    assert arima_forecast(parts, fit_on=("train", "val")).where("Predicted is null").count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    """Holidays add 40 to sales; temperature drives both sales and the chance of a holiday."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(4000):
        x = rng.uniform()
        t = int(rng.uniform() < 0.2 + 0.6 * x)
        rows.append((i % 20, 1, i, t, float(100 * x), float(50 + 100 * x + 40 * t + rng.normal(0, 5))))
    return spark.createDataFrame(rows, "Store int, Dept int, Date int, IsHoliday int, Temperature double, Weekly_Sales double")


def test_planted_uplift_is_recovered(planted):
    controls = ("Temperature",)
    res = uplift.cross_fit_residuals(planted, controls, settings=learners.Boosting(15, 3, 0.2))
    assert res.count() == planted.count()
    row = uplift.average_effect(res, cluster="Store").first()
    assert row.Lower < 40 < row.Upper and row.Upper - row.Lower < 6
    effects, model = uplift.causal_uplift(res, controls, learners.Forest(20, 4, 50))
    assert effects.agg(F.avg("Holiday_Uplift")).first()[0] == pytest.approx(40, abs=3)
    assert not [c for c in effects.columns if c.startswith("_")]
    levels = {r.Level: r.n for r in uplift.uplift_rollups(effects).groupBy("Level").agg(F.count("*").alias("n")).collect()}
    assert levels == {"Series": 20, "Store": 20, "Dept": 1, "All": 1}


def test_what_if_difference(planted):
    used = ("Temperature", "IsHoliday")
    model = learners.fit_boosting(planted, used, learners.Boosting(30, 4, 0.2))
    out = uplift.what_if_uplift(model, planted, used)
    row = out.agg(F.avg("Holiday_Uplift"), F.max(F.abs(F.col("Holiday_Uplift") - F.col("With_Holiday") + F.col("Without_Holiday")))).first()
    assert row[0] == pytest.approx(40, abs=5) and row[1] == 0.0
    assert out.where("IsHoliday not in (0, 1)").count() == 0 and out.agg(F.sum("IsHoliday")).first()[0] == planted.agg(F.sum("IsHoliday")).first()[0]


def test_task_functions_travel_by_value():
    from pyspark import cloudpickle

    import shelfcast.functions.ttest  # noqa: F401

    shipped = cloudpickle.list_registry_pickle_by_value()
    assert {"shelfcast.functions.ttest", "shelfcast.operators.series_fit", "shelfcast.operators.learners", "shelfcast.operators.binned_trees"} <= set(shipped)
