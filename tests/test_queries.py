"""Registered queries against DuckDB, the shape of their plans, and the pages built on the same tables."""

import re

import pytest

import __spark_entry__ as contract
from shelfcast.operators import learners
from workload import check, model_queries
from workload.registry import QUERIES, Tables

# Invariants and plans do not depend on the number of trees; the published sizes run in the registered queries.
model_queries.SIZES.update({
    "nuisance": learners.Boosting(6, 3, 0.3, 0.8, 0.8), "causal": learners.Forest(6, 4, 20), "what-if": learners.Boosting(6, 3, 0.3),
    "global": learners.Boosting(6, 3, 0.3), "global forest": learners.Forest(4, 4), "basic": learners.Boosting(8, 3, 0.3),
    "tuned": learners.Boosting(8, 3, 0.3, 0.8, 0.8), "early stop": learners.Boosting(8, 3, 0.3, early_stop=True), "hybrid": learners.Boosting(8, 3, 0.3),
    "forest": learners.Forest(6, 4),
})
CHECKED = [n for n, q in QUERIES.items() if q.sql is not None]


@pytest.fixture(scope="module")
def oracle(data_dir):
    return check.oracle(data_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, oracle, data_dir, name):
    verdict, _ = check.compare(QUERIES[name], spark, oracle, data_dir)
    assert verdict.startswith("ok"), verdict


def test_contract(spark, data_dir):
    assert contract.entry(spark).count() == 10
    assert set(contract.oracle_sql()) <= set(contract.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_join_and_python_only_for_fits_and_tail_probabilities(spark, data_dir):
    for name in CHECKED:
        text = plan_of(QUERIES[name](spark, data_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert bool(re.search("Python|Pandas", text)) == (name == "factor_ttest" or "UDF4" in QUERIES[name].covers), name


def test_bounds_reach_the_scan(spark, data_dir):
    text = plan_of(QUERIES["filtered_sales"](spark, data_dir))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    assert any("GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p for p in pushed)
    assert any("In(p_type" in p for p in pushed)
    text = plan_of(QUERIES["one_series"](spark, data_dir))
    assert re.search(r"PushedFilters: \[[^\]]*p_type", text)


def test_scan_reads_only_what_is_needed_and_filters_early(spark, data_dir):
    text = plan_of(QUERIES["weekly_sales_fact"](spark, data_dir))
    schema = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)", text) if "l_partkey" in s)
    assert "l_tax" not in schema and "l_returnflag" not in schema
    assert "IsNotNull(l_partkey)" in text


def test_top_k_is_a_heap_and_ranks_are_limited_before_the_shuffle(spark, data_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_weeks"](spark, data_dir))
    assert "WindowGroupLimit" in plan_of(QUERIES["top_weeks_per_series"](spark, data_dir))


INVENTORY = {
    "SRC": 6, "SNK": 5, "PRJ": 7, "FLT": 9, "CLN": 8, "JN": 13, "AGG": 33, "WIN": 12, "SRT": 6, "SMP": 1, "SPL": 3,
    "SET": 4, "RSH": 2, "DT": 10, "MTH": 4, "CND": 2, "STR": 4, "UDF": 5, "PRF": 6, "OUT": 10, "FTR": 4, "MDL": 13,
    "EVL": 10, "IMP": 4, "UPL": 4, "XPL": 4, "EDA": 5,
}


def test_every_inventory_row_is_exercised():
    covered = {c for q in QUERIES.values() for c in q.covers}
    wanted = {f"{k}{i}" for k, n in INVENTORY.items() for i in range(1, n + 1)}
    assert wanted - covered == set()


def test_pages_return_rows(spark, data_dir):
    from shelfcast.operators import baselines, explain, outliers
    from shelfcast.names import FACTORS
    from shelfcast.plans import pages
    from shelfcast.sources.readers import Bundle
    from shelfcast.sources.warehouse import is_holiday_week

    t = Tables(spark, data_dir)
    importance = explain.correlation_importance(t.fact, FACTORS)
    b = Bundle(t.fact.cache(), t.results.cache(), t.profile.cache(), importance)
    some = t.fact.groupBy("Store", "Dept").count().orderBy("Store", "Dept").first()
    all_pages = {
        "performance": pages.performance_page(b, "month", date_from="1996-01-01"),
        "department": pages.department_report(b, some.Store, some.Dept),
        "departments": pages.department_report(b),
        "case": pages.case_study(b, [(some.Store, some.Dept), (some.Store, some.Dept + 1)]),
        "prediction": pages.prediction_page(b, baselines.latest_scenarios(t.fact, is_holiday_week)),
        "outliers": pages.outlier_page(b, stores=[some.Store]),
        "inventory": pages.inventory_page(b, 0.3, 0.2, 1.5),
        "reports": pages.report_page(b, "Naive"),
    }
    may_be_empty = {"extreme", "causes_selected", "causes_by_month", "advice"}
    for page, tables in all_pages.items():
        for name, df in tables.items():
            assert df.limit(1).count() == 1 or name in may_be_empty, (page, name)
    one = all_pages["department"]["history"]
    assert one.select("Store", "Dept").distinct().count() == 1
    b.unpersist()
