import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_fact
from shelfcast.operators import features, learners, series_trees, stored_trees
from shelfcast.sources import readers, sinks

MODELS = {
    "XGBoost": learners.Boosting(12, 3, 0.3, 0.8, 0.6),
    "XGBoost Early Stop": learners.Boosting(60, 3, 0.3, early_stop=True, patience=3),
    "Random Forest": learners.Forest(7, 5),
}


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(11)
    temps = {(s, d): rng.uniform(0, 100, 143) for s in (1, 2) for d in (1, 2)}
    series = {k: [(float(t * k[1] + rng.normal(0, 5)), int(i % 13 == 0), 0.0) for i, t in enumerate(ts)] for k, ts in temps.items()}
    fact = make_fact(spark, series, lambda s, d, i: (float(temps[(s, d)][i]), 3.0, None if i == 7 else 200.0, 8.0))
    return features.label_split(fact, "2011-06-01", "2012-01-01").cache()


def _by(rows):
    return {(r.Store, r.Dept, r.Date, r.Model): r.Predicted for r in rows}


def test_stored_models_score_as_the_fit_did(spark, parts, tmp_path):
    direct = _by(series_trees.series_models(parts, MODELS).collect())
    path = str(tmp_path / "models")
    stored_trees.save_series_models(stored_trees.fit_series_models(parts, MODELS), path)
    models = readers.read_parquet(spark, path)
    assert models.count() == 4 * len(MODELS)
    later = _by(stored_trees.score_series(parts.where("split = 'test'").drop("Weekly_Sales"), models).collect())
    assert later == direct and len(later) > 0
    trees = {(r.Store, r.Dept, r.Model): r.Trees for r in models.select("Store", "Dept", "Model", "Trees").collect()}
    kept = {(r.Store, r.Dept, r.Model): r.Trees for r in series_trees.series_models(parts, MODELS).collect()}
    assert trees == kept and min(trees[k] for k in trees if k[2] == "XGBoost Early Stop") < 60


def test_the_scaler_is_stored_with_the_model(parts):
    models = stored_trees.fit_series_models(parts, {"XGBoost": MODELS["XGBoost"]}, scale=True)
    train = parts.where("split = 'train'").groupBy("Store", "Dept").agg(
        F.avg("Temperature").alias("m"), F.stddev_pop("Temperature").alias("s"), F.avg("Weekly_Sales").alias("y")).collect()
    want = {(r.Store, r.Dept): r for r in train}
    rows = models.collect()
    assert len(rows) == 4
    for r in rows:
        at = list(r.Features).index("Temperature")
        ref = want[(r.Store, r.Dept)]
        assert r.Means[at] == pytest.approx(ref.m) and r.Scales[at] == pytest.approx(ref.s) and r.Start == pytest.approx(ref.y)
        assert r.Scales[list(r.Features).index("Fuel_Price")] == 1.0  # constant
    # Trees do not depend on the scale but for rounding.
    test = parts.where("split = 'test'")
    plain = _by(stored_trees.score_series(test, stored_trees.fit_series_models(parts, {"XGBoost": MODELS["XGBoost"]})).collect())
    scaled = _by(stored_trees.score_series(test, models).collect())
    assert plain.keys() == scaled.keys()
    assert np.mean([abs(plain[k] - scaled[k]) < 1e-6 for k in plain]) > 0.95


def test_weeks_without_sales_and_series_without_models(spark, parts):
    models = stored_trees.fit_series_models(parts.where("split <> 'train' or Dept = 1"), {"Random Forest": MODELS["Random Forest"]}).cache()
    assert {r.Dept for r in models.collect()} == {1}
    rows = features.future_weeks(parts, 3).drop("step")
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in learners.MODEL_FEATURES if c not in ("Store", "Dept")})
    rows = rows.unionByName(rows.where("Store = 1 and Dept = 1")).unionByName(rows.limit(1).withColumns({"Store": F.lit(None).cast("int"), "Dept": F.lit(1)}))
    found = stored_trees.score_series(rows, models).collect()
    assert len(found) == 3 * 4 + 3 + 1
    assert all((r.Predicted is None) == (r.Model is None) == (r.Dept == 2 or r.Store is None) for r in found)
    assert max(r.Date for r in found) == dt.date(2010, 2, 5) + dt.timedelta(weeks=145)
    assert stored_trees.score_series(rows.limit(0), models).count() == 0
    assert stored_trees.score_series(rows, models.limit(0)).where("Predicted is not null").count() == 0


def test_fit_refuses_to_watch_what_it_fits(parts):
    with pytest.raises(ValueError, match="validation part"):
        stored_trees.fit_series_models(parts, {"x": MODELS["XGBoost Early Stop"]}, fit_on=("train", "val"))


def test_stored_scaler(spark, tmp_path):
    train = spark.createDataFrame([(1.0, 5.0, 1), (3.0, 5.0, 2), (None, 5.0, 3)], "a double, b double, n int")
    path = str(tmp_path / "scaler")
    sinks.write_table(features.fit_scaler(train, ["a", "b", "n"]), path)
    scaler = readers.read_parquet(spark, path)
    row = features.apply_scaler(spark.createDataFrame([(4.0, 7.0, 2)], "a double, b double, n int"), scaler, ["a", "b", "n"]).first()
    assert (row.a, row.b, row.n) == (2.0, 2.0, 0.0)
