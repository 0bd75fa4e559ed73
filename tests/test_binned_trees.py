"""Trees grown from merged histograms, exact Shapley values, and the honest causal forest."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import binned_trees as B
from shelfcast.operators import causal_forest, explain, learners, uplift

FEATURES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(1500):
        a, b, c, d = rng.uniform(0, 10, 4).round(2).tolist()
        out.append((i, i % 12, a, b, c, None if i % 17 == 0 else d, 5 * (a > 4) * b + c + float(rng.normal(0, 0.1)), float(a + rng.normal() > 5)))
    return spark.createDataFrame(out, "id long, Store int, a double, b double, c double, d double, y double, t double")


def blocks(rows):
    return B.blocks_of(rows.withColumn("all", F.lit(1.0)), FEATURES, {"y": "y", "t": "t", "all": "all"}, ["id"])


def test_models_do_not_depend_on_the_number_of_blocks(rows, monkeypatch):
    """One block grows whole trees in a task; many blocks merge their histograms level by level."""
    tasks = [B.Task("y", "all"), B.Task("t", "all", logistic=True)]
    one = B.boosted(blocks(rows), tasks, 4, 3, 0.3, 0.8, 0.8)
    monkeypatch.setattr(B, "BLOCK_ROWS", 400)
    many = blocks(rows)
    assert many.count == 4
    x = np.random.default_rng(1).uniform(0, 10, (200, 4))
    for m, n in zip(one, B.boosted(many, tasks, 4, 3, 0.3, 0.8, 0.8), strict=True):
        assert m.roots.tolist() == n.roots.tolist() and m.feature.tolist() == n.feature.tolist()
        np.testing.assert_allclose(m.predict(x), n.predict(x), rtol=1e-9)


def test_boosting_learns_and_scores_rows(rows):
    model = learners.fit_second_order(rows, FEATURES, learners.Boosting(60, 4, 0.2), "y", ["id"])
    scored = learners.score(model, rows)
    assert scored.columns == [*rows.columns, "Predicted"]
    left = scored.agg((F.sum((F.col("y") - F.col("Predicted")) ** 2) / F.sum((F.col("y") - 15) ** 2)).alias("r")).first().r
    assert left < 0.01
    names = [r.Feature for r in explain.model_importance(rows.sparkSession, model, FEATURES).collect()]
    assert set(names[:2]) == {"a", "b"} and names[-1] == "d"


def test_first_split_of_a_level_is_the_best_of_all(rows):
    """Against a plain search over every border of every feature."""
    b = blocks(rows)
    block = next(B.unpacked(b.table.toArrow(), b.names))
    y = block.columns["y"]
    stats = [y - y.mean(), np.ones(len(y)), np.ones(len(y))]
    tree = B.grown_here(block, stats, B.Rule(1, 1.0, 5.0), np.ones(4, bool))
    best = (0.0, None, None)
    part = lambda m: stats[0][m].sum() ** 2 / (m.sum() + 1.0)
    for f, cut in itertools.product(range(4), range(255)):
        left = block.bins[:, f] <= cut
        if 5 <= left.sum() <= len(y) - 5:
            gain = part(left) + part(~left) - part(np.ones(len(y), bool))
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    assert (tree.feature[0], tree.cut[0]) == best[1:] and tree.gain[0] == pytest.approx(best[0])


def full_enumeration(model, x, background):
    """Shapley values by their definition: all subsets of all features."""
    n = len(x)
    worth = {}
    for size in range(n + 1):
        for s in itertools.combinations(range(n), size):
            mixed = background.copy()
            mixed[:, list(s)] = x[list(s)]
            worth[s] = model.predict(mixed).mean()
    out = np.zeros(n)
    for i in range(n):
        others = [k for k in range(n) if k != i]
        for size in range(n):
            for s in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                out[i] += weight * (worth[tuple(sorted((*s, i)))] - worth[s])
    return out


def test_shapley_values_equal_full_enumeration(spark):
    rng = np.random.default_rng(8)
    names = [f"f{k}" for k in range(8)]
    x = rng.integers(0, 6, (600, 8)).astype(float)
    y = x[:, 0] * x[:, 1] + 3 * (x[:, 2] > 2) * x[:, 3] - x[:, 4] + rng.normal(0, 0.3, 600)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ["id", *names, "y"])
    model = learners.fit_second_order(df, names, learners.Boosting(25, 5, 0.3), "y", ["id"])
    background = x[:20]
    got = B.shapley_matrix(model, x[100:106], background)
    for row, values in zip(x[100:106], got, strict=True):
        np.testing.assert_allclose(values, full_enumeration(model, row, background), atol=1e-9)
    found = B.tree_shapley(model, df, ["id"], background)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    total = sum((F.col(f"Shap_{f}") for f in names[1:]), F.col("Shap_f0"))
    row = found.agg(F.max(F.abs(total + F.col("Baseline") - F.col("Predicted"))), F.count("id")).first()
    assert row[0] < 1e-8 and row[1] == 600


@pytest.fixture(scope="module")
def treated(spark):
    """The effect is 20 where x is low and 60 where it is high; z drives both sales and the chance of treatment."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(8000):
        x, z = rng.uniform(0, 1, 2).tolist()
        t = int(rng.uniform() < 0.3 + 0.4 * z)
        effect = 60.0 if x > 0.5 else 20.0
        rows.append((i % 40, 1, i, t, x, z, effect, 100 + 80 * z + effect * t + float(rng.normal(0, 8))))
    return spark.createDataFrame(rows, "Store int, Dept int, Date int, IsHoliday int, x double, z double, Effect double, Weekly_Sales double")


@pytest.fixture(scope="module")
def judged(treated):
    res = uplift.cross_fit_residuals(treated, ("x", "z"), settings=learners.Boosting(60, 4, 0.1, 0.8, 1.0))
    effects, model = uplift.causal_uplift(res, ("x", "z"), learners.Forest(200, 6, 50))
    return effects.cache(), model


def test_planted_effects_are_recovered_per_row(judged):
    effects, model = judged
    assert model.importances()[0] > 0.8  # x alone moves the effect
    away = effects.where("abs(x - 0.5) > 0.05")
    assert away.agg(F.avg(F.abs(F.col("Holiday_Uplift") - F.col("Effect")))).first()[0] < 3


def test_intervals_cover_planted_effects(judged):
    effects, _ = judged
    away = effects.where("abs(x - 0.5) > 0.05")
    inside = away.agg(F.avg(F.col("Effect").between(F.col("Lower"), F.col("Upper")).cast("int"))).first()[0]
    assert inside >= 0.9
    row = uplift.mean_interval(effects).first()
    assert row.Lower < 40 < row.Upper and row.Upper - row.Lower < 20


def test_honest_halves_and_bags():
    block = B.Block(0, np.arange(4000), np.zeros((4000, 1), np.uint8), {"cluster": np.arange(4000) % 20 + 0.0})
    a, b = (causal_forest._weights(block, 3, 5, 42, half) for half in (False, True))
    assert not ((a > 0) & (b > 0)).any()
    whole = a + b
    same_bag = sum(causal_forest._weights(block, 4, 5, 42, half) for half in (False, True))
    other_bag = sum(causal_forest._weights(block, 5, 5, 42, half) for half in (False, True))
    assert (whole == same_bag).all() and not (whole == other_bag).all()
    assert all(len(set(whole[block.columns["cluster"] == c])) == 1 for c in range(20))
    draws = np.searchsorted(causal_forest.POISSON, B.uniform(np.arange(100_000), 1))
    assert draws.mean() == pytest.approx(1, abs=0.02) and draws.var() == pytest.approx(1, abs=0.03)


def test_forest_does_not_depend_on_the_number_of_blocks(treated, monkeypatch):
    rows = treated.where("Date < 3000").withColumns({"ty": F.col("Weekly_Sales") - 140, "tt": F.col("IsHoliday") - 0.5})
    how = dict(trees=6, depth=3, min_leaf=30)
    one = causal_forest.fit(rows, ("x", "z"), "ty", "tt", ["Store"], ["Date"], **how)
    monkeypatch.setattr(B, "BLOCK_ROWS", 800)
    many = causal_forest.fit(rows, ("x", "z"), "ty", "tt", ["Store"], ["Date"], **how)
    assert one.trees.feature.tolist() == many.trees.feature.tolist()
    x = np.random.default_rng(1).uniform(0, 1, (100, 2))
    np.testing.assert_allclose(one.effects(x)[0], many.effects(x)[0], rtol=1e-9)


def test_functions_ship_to_workers_without_the_package(tmp_path):
    """What the tasks of the fits run is unpickled in a process that cannot import the library."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from shelfcast.operators import series_trees

    made = {"forest": learners.Forest(3, 2), "boosting": learners.Boosting(3, 2, 0.3)}
    fitted = cloudpickle.dumps((series_trees._fitted, made, B.grown_here, causal_forest._weights))
    (tmp_path / "made").write_bytes(fitted)
    code = (
        "import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p and p != '']\n"
        "import numpy as np, pandas as pd\n"
        f"fitted, made, grown, weights = pickle.loads(open({str(tmp_path / 'made')!r}, 'rb').read())\n"
        "g = pd.DataFrame({'x': np.arange(20.0), '_y': np.arange(20.0), '_split': ['train'] * 20})\n"
        "for m in made.values(): assert fitted(g, ['x'], m, ('train',), np.zeros((2, 1)))[1] == 3\n"
        "assert 'shelfcast' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin"}, timeout=100)


def test_new_series_fits_ship_to_workers_without_the_package(tmp_path):
    """The batch functions of the likelihood, the trend and the stored trees run where the library cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from shelfcast.operators import arima_likelihood, stored_trees, trend_holidays

    (tmp_path / "made").write_bytes(cloudpickle.dumps((arima_likelihood.fit, trend_holidays.fit, stored_trees.score_trees, stored_trees.boost, learners.Boosting(3, 2, 0.3))))
    code = (
        "import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p and p != '']\n"
        "import numpy as np\n"
        f"arima, trend, score, boost, settings = pickle.loads(open({str(tmp_path / 'made')!r}, 'rb').read())\n"
        "x = np.random.default_rng(0).normal(size=(40, 2))\n"
        "assert np.abs(arima(x.T.copy(), np.array([40, 40]))[0]).max() < 1\n"
        "assert trend([x], [np.abs(x)], [x[:, 0]], np.ones(2))[3][0] < 1e-3\n"
        "grown = []\n"
        "out = boost(x, x[:, 0], settings, None, [x], grown)[0][0]\n"
        "flat = [np.concatenate([t[k] for t in grown]) for k in range(4)]\n"
        "assert (score(x, x[:, 0].mean(), np.array([len(t[0]) for t in grown]), *flat) == out).all()\n"
        "assert 'shelfcast' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin"}, timeout=100)
