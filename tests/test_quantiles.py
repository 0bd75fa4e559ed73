import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.functions.quantiles import box_outliers, box_summary, exact_quantiles, histogram, quantiles_wide

PROBS = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]


def brute(values, probs):
    return {p: float(np.quantile(values, p)) for p in probs}


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_whatever_the_sketch_accuracy(spark, accuracy):
    rng = np.random.default_rng(1)
    groups = {
        "spread": rng.normal(size=5000),
        "heavy": np.repeat([1.0, 2.0, 3.0], [4000, 10, 1]),
        "tail": rng.pareto(1.1, size=3000),
        "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("spread", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {(r.k, r.prob): r.value for r in exact_quantiles(df, "v", PROBS, ("k",), accuracy).collect()}
    for k, vs in groups.items():
        for p, want in brute(vs, PROBS).items():
            assert got[(k, p)] == pytest.approx(want, rel=1e-12, abs=1e-12), (k, p)
    assert not any(k == "empty" for k, _ in got)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_small_integer_lists(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.prob: r.value for r in exact_quantiles(df, "v", PROBS).collect()}
    assert got == pytest.approx(brute(values, PROBS))


def test_global_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", [0.5]).collect() == []


def test_wide_form(spark):
    df = spark.range(1, 6).select(F.col("id").cast("double").alias("v"))
    row = quantiles_wide(df, "v", {"Q1": 0.25, "Q3": 0.75}).first()
    assert (row.Q1, row.Q3, row.n) == (2.0, 4.0, 5)


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (None,)], "v double")
    rows = histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0, 1]
    assert rows[-1].bin_end == 10.0


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [r["count"] for r in histogram(df, "v", 3).orderBy("bin").collect()] == [4, 0, 0]


def test_box_summary_and_points(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    row = box_summary(df, "v", ("k",)).first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert (row.Q1, row.Q3) == (q1, q3)
    assert (row.Lower_Whisker, row.Upper_Whisker, row.Outliers, row.Count) == (1.0, 5.0, 1, 6)
    assert [r.v for r in box_outliers(df, "v", ("k",)).collect()] == [100.0]
