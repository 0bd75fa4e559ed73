"""The dashboard's pages: each returns its tables by name, lazily; charts read aggregated rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.quantiles import box_summary, few_groups, histogram
from shelfcast.names import DATE, HOLIDAY, KEYS, TARGET
from shelfcast.operators import aggregates, baselines, combine, evaluate, explain, inventory, outliers, profile
from shelfcast.sources.readers import Bundle


def _one(df: DataFrame, store: int | None, dept: int | None) -> DataFrame:
    return combine.optional_in(df, Store=[store] if store is not None else None, Dept=[dept] if dept is not None else None)


def performance_page(b: Bundle, unit: str = "day", **filters) -> dict[str, DataFrame]:
    """Sales, time and model overview; ``filters`` are those of ``apply_filters``."""
    sales = combine.apply_filters(b.fact, **filters)
    sizes = sales.groupBy("Store", "Type").agg(F.max("Size").alias("Size"))
    naive = b.results.where(F.col("Model") == "Naive")
    return {
        "kpis": aggregates.global_kpis(sales),
        "histogram": histogram(sales, TARGET, 50),
        "holiday_sales": aggregates.holiday_sales(sales),
        "store_performance": aggregates.store_performance(sales),
        "sales_by_type": box_summary(sales, TARGET, ("Type",), few=few_groups(b.fact, ("Type",))),
        "size_by_type": box_summary(sizes, "Size", ("Type",)),
        "trend": aggregates.resample(sales, unit),
        "monthly": aggregates.monthly_pattern(sales),
        "yearly": aggregates.yearly_totals(sales),
        "headline": evaluate.headline_kpis(b.results),
        "naive_wins": evaluate.naive_wins_by_min(b.results),
        "model_means": b.results.groupBy("Model").agg(F.avg("MAPE").alias("MAPE")).orderBy("MAPE"),
        "wins": evaluate.win_counts(b.results),
        "error_histogram": histogram(naive, "MAPE", 30),
    }


def department_overview(b: Bundle) -> DataFrame:
    """Characteristics, outlier flag, uplift and recommendation of every series."""
    levels = outliers.dept_outliers(b.fact).select(*KEYS, "Mean", "Z_Score", "Is_Outlier")
    rows = b.profile.join(levels, list(KEYS), "left")
    if b.uplift_by_series is not None:
        rows = rows.join(b.uplift_by_series.select(*KEYS, "Holiday_Uplift"), list(KEYS), "left")
    return profile.recommendation_advice(profile.confidence_band(rows))


def department_report(b: Bundle, store: int | None = None, dept: int | None = None, top_n: int = 5) -> dict[str, DataFrame]:
    """Deep dive into one series, or into all of them when no key is given."""
    sales = _one(b.fact, store, dept)
    tables = {
        "characteristics": _one(department_overview(b), store, dept),
        "history": sales.select(*KEYS, DATE, TARGET, HOLIDAY),
        "holidays": sales.where(F.col(HOLIDAY).cast("int") == 1).select(*KEYS, DATE, TARGET),
        "monthly": aggregates.monthly_pattern(sales, KEYS),
        "models": _one(b.results, store, dept).select(*KEYS, "Model", "MAE", "MAPE"),
    }
    if b.importance is not None:
        importance = _one(b.importance, store, dept)
        tables["top_features"] = combine.top_k_per_group(importance, KEYS, "Importance", top_n, ("Feature",))
        tables["importance_summary"] = explain.importance_summary(importance, top_n)
    return tables


def case_study(b: Bundle, series: Sequence[tuple[int, int]]) -> dict[str, DataFrame]:
    """Yearly, monthly, holiday and promotion figures of chosen series, and their weeks side by side."""
    wanted = b.fact.sparkSession.createDataFrame([tuple(s) for s in series], "Store int, Dept int")
    sales = combine.keep_listed(b.fact, wanted)
    label = F.format_string("S%dD%d", "Store", "Dept")
    labels = [f"S{s}D{d}" for s, d in series]
    return {
        "character": profile.diagnose_volatility(profile.sales_character(sales)),
        "yearly": aggregates.yearly_totals(sales, KEYS),
        "monthly": aggregates.monthly_pattern(sales, KEYS),
        "lift": aggregates.lift_and_season(sales),
        "promo": profile.promo_by_markdown(sales),
        "extreme": outliers.extreme_weeks(sales),
        "side_by_side": sales.withColumn("_label", label).groupBy(DATE).pivot("_label", labels).agg(F.first(TARGET)),
    }


def prediction_page(b: Bundle, scenarios: DataFrame) -> dict[str, DataFrame]:
    """Next-week forecasts for the given scenarios, and the history they extend."""
    forecast = baselines.next_week_forecast(scenarios, b.profile)
    asked = combine.keep_listed(b.fact, scenarios)
    return {"forecast": forecast, "history": baselines.history_with_forecast(asked, forecast)}


def outlier_page(
    b: Bundle, stores: Sequence[int] | None = None, depts: Sequence[int] | None = None
) -> dict[str, DataFrame]:
    """Outlying series and weeks, what sets them apart, and why."""
    levels = outliers.dept_outliers(b.fact, b.profile)
    flagged = outliers.weekly_outliers(b.fact)
    causes = outliers.label_causes(outliers.factor_scores(flagged, few_stores=few_groups(b.fact, ("Store",))))
    impact = inventory.inventory_impact(b.results, b.fact, b.profile)
    kinds = outliers.kind_sales(b.fact, levels)
    return {
        "series": levels,
        "weeks": flagged.where("Is_Weekly_Outlier"),
        "rate": outliers.outlier_rate(flagged),
        "sample": outliers.contrast_sample(levels),
        "distributions": box_summary(kinds, "Sales", ("Type",), few=True),  # two kinds
        "impact": inventory.impact_contrast(impact, levels),
        "factors": outliers.factor_comparison(flagged),
        "tests": outliers.factor_ttest(flagged),
        "causes": outliers.cause_distribution(causes),
        "causes_selected": outliers.cause_distribution(causes, stores, depts),
        "causes_by_month": outliers.cause_by_month(causes, stores, depts),
        "advice": outliers.advice_for_causes(
            combine.optional_in(causes, Store=stores, Dept=depts), combine.cause_advice(b.fact.sparkSession)
        ),
    }


def inventory_page(
    b: Bundle, profit_margin: float = 0.25, holding_cost: float = 0.25, stockout_penalty: float = 2.0
) -> dict[str, DataFrame]:
    impact = inventory.inventory_impact(
        b.results, b.fact, b.profile, profit_margin, holding_cost, stockout_penalty
    )
    return {
        "totals": inventory.impact_totals(impact),
        "top": combine.top_k(impact, "Total_Impact", 10, ties=KEYS).select(*KEYS, "MAPE", "Total_Impact"),
        "histogram": histogram(impact, "Total_Impact", 30),
        "by_volatility": inventory.impact_by_volatility(impact),
        "potential": inventory.improvement_potential(b.results, b.fact),
    }


def report_page(b: Bundle, model: str | None = None) -> dict[str, DataFrame]:
    """Model summary, rankings for one model or all, and the downloadable report."""
    shown = combine.optional_in(b.results, Model=[model] if model else None)
    ties = (*KEYS, "Model")
    ranking = shown.select(*KEYS, "Model", "MAPE")
    return {
        "summary": evaluate.model_summary(b.results),
        "distribution": box_summary(b.results, "MAPE", ("Model",)),
        "best": combine.top_k(ranking, "MAPE", 10, largest=False, ties=ties),
        "worst": combine.top_k(ranking, "MAPE", 10, ties=ties),
        "report": aggregates.summary_report(b.results, b.fact),
    }
