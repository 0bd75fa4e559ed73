"""Profiles, forecasts, evaluation and cost per series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.operators import aggregates, baselines, combine, evaluate, features, inventory, profile
from workload.registry import query, round_columns, rounded

_METRIC_DIGITS = {"HolidayLift%": 6, "SeasonalRatio": 8, "CV": 8, "ZeroPct": 6, "TrendStrength": 8, "PromoLift%": 6}
_METRICS = ", ".join(f'ROUND("{c}", {d}) AS "{c}"' for c, d in _METRIC_DIGITS.items())
_RESULT_DIGITS = dict(MAE=3, RMSE=4, MAPE=6, Avg_Sales=3)
_RESULT = "Store, Dept, Store_Type, Model, ROUND(MAE, 3) AS MAE, ROUND(RMSE, 4) AS RMSE, ROUND(MAPE, 6) AS MAPE, ROUND(Avg_Sales, 3) AS Avg_Sales"


@query("EVL1 MDL1 SPL1 SRT3 WIN11 UDF5", f"SELECT {_RESULT} FROM results WHERE Model = 'Naive' ORDER BY results.MAPE DESC, Store, Dept LIMIT 10")
def naive_wape_worst10(t):
    naive = evaluate.league_table(baselines.baseline_forecasts(t.split, models=("Naive",)), t.stores)
    return rounded(combine.top_k(naive, "MAPE", 10, ties=("Store", "Dept")), **_RESULT_DIGITS)


@query("PRF1 AGG9 AGG10 AGG11 AGG12 AGG13 AGG14 UDF3 WIN10", f"SELECT Store, Dept, DataPoints, {_METRICS} FROM metrics")
def dept_profile(t):
    return rounded(profile.series_metrics(t.fact), **_METRIC_DIGITS)


@query("PRF2 UDF3 CND1", "SELECT Store, Dept, Recommended, ROUND(Confidence, 8) AS Confidence, CAST(ns AS INTEGER) AS Naive_Score, CAST(xs AS INTEGER) AS XGBoost_Score, DataPoints FROM judged")
def dept_recommendation(t):
    judged = profile.recommend(profile.series_metrics(t.fact))
    return rounded(judged.select("Store", "Dept", "Recommended", "Confidence", "Naive_Score", "XGBoost_Score", "DataPoints"), Confidence=8)


@query("PRF1 PRF2 MTH2", "SELECT * REPLACE (ROUND(Confidence, 8) AS Confidence) FROM profile")
def published_profile(t):
    return rounded(t.profile, Confidence=8)


@query("PRF2 FLT9", """SELECT s.Store, s.Dept, CASE WHEN n < 120 THEN 'NAIVE (Insufficient Data)' ELSE Recommended END AS Recommended,
    ROUND(CASE WHEN n < 120 THEN 0.0::DOUBLE ELSE Confidence END, 8) AS Confidence, n AS DataPoints
    FROM (SELECT Store, Dept, COUNT(*) AS n FROM fact GROUP BY ALL) s LEFT JOIN judged j ON s.Store = j.Store AND s.Dept = j.Dept""")
def all_recommendations(t):
    return rounded(profile.classify_all(t.fact, min_rows=120), Confidence=8)


@query("PRF3 AGG9 AGG10", """SELECT Store, Dept, COALESCE(lift > 0.02, FALSE) OR COALESCE(season > 1.02, FALSE) AS IsHolidayDept, ROUND(lift * 100, 6) AS "HolidayLift%",
    ROUND(season, 8) AS SeasonalRatio, CASE WHEN COALESCE(lift > 0.02, FALSE) OR COALESCE(season > 1.02, FALSE) THEN 'Naive' ELSE 'XGBoost' END AS Recommended_Model FROM (
    SELECT Store, Dept, COUNT(*) AS n, AVG(Weekly_Sales) FILTER (IsHoliday = 1) / AVG(Weekly_Sales) FILTER (IsHoliday = 0) - 1 AS lift,
           AVG(Weekly_Sales) FILTER (month(Date) IN (11, 12)) / AVG(Weekly_Sales) FILTER (month(Date) NOT IN (11, 12)) AS season
    FROM fact GROUP BY ALL) WHERE n >= 50""")
def holiday_dept_rule(t):
    rule = profile.holiday_rule(t.fact, lift_threshold=0.02, season_threshold=1.02)
    return rounded(rule, **{"HolidayLift%": 6, "SeasonalRatio": 8})


_DIAGNOSED = """(SELECT *, CASE WHEN sd > m * 2 THEN 'EXTREME VOLATILITY' WHEN z > n * 0.5 THEN 'INTERMITTENT DEMAND' WHEN mx > m * 10 THEN 'EXTREME SPIKES'
    ELSE 'MYSTERIOUS - NEED DEEPER DIVE' END AS Diagnosis FROM (SELECT Store, Dept, COUNT(*) AS n, AVG(v) AS m, STDDEV_SAMP(v) AS sd, MAX(v) AS mx,
    COUNT(*) FILTER (v = 0) AS z FROM (SELECT g.Store, g.Dept, COALESCE(s.Weekly_Sales, 0) AS v FROM (
      SELECT Store, Dept, CAST(unnest(generate_series(MIN(Date), MAX(Date), INTERVAL 7 DAY)) AS DATE) AS d FROM sales GROUP BY Store, Dept) g
      LEFT JOIN sales s ON s.Store = g.Store AND s.Dept = g.Dept AND s.Date = g.d) GROUP BY ALL))"""


def _diagnosed(t):
    return profile.diagnose_volatility(profile.sales_character(features.fill_calendar(t.sales.drop("IsHoliday"))))


@query("PRF4 AGG12", f"SELECT Store, Dept, n AS Weeks, z AS ZeroWeeks, Diagnosis FROM {_DIAGNOSED}")
def volatility_diagnosis(t):
    return _diagnosed(t).select("Store", "Dept", "Weeks", "ZeroWeeks", "Diagnosis")


@query("PRF6 JN13", f"""SELECT Store, Dept, Diagnosis, CAST(seq AS INTEGER) AS seq, advice FROM {_DIAGNOSED} JOIN (VALUES
    ('EXTREME VOLATILITY', 1, 'Report this as a finding: "Some departments show extreme volatility"'),
    ('EXTREME VOLATILITY', 2, 'Consider removing from analysis OR using specialized models'),
    ('EXTREME VOLATILITY', 3, 'Mention in limitations: "Very volatile departments are harder to forecast"'),
    ('INTERMITTENT DEMAND', 1, 'Use specialized models for intermittent demand (Croston''s method)'),
    ('INTERMITTENT DEMAND', 2, 'Report as a separate case study'),
    ('INTERMITTENT DEMAND', 3, 'Show that different products need different approaches'),
    ('OTHER', 1, 'Investigate further: Check for data errors'), ('OTHER', 2, 'Look at promotional periods (MarkDown columns)'),
    ('OTHER', 3, 'Check if this department sells seasonal products')) a(class, seq, advice)
    ON class = CASE WHEN Diagnosis IN ('EXTREME VOLATILITY', 'INTERMITTENT DEMAND') THEN Diagnosis ELSE 'OTHER' END""")
def diagnosis_advice(t):
    return profile.diagnosis_advice(_diagnosed(t))


@query("PRF5 PRF6", """SELECT Store, Dept, Recommended, CASE WHEN CV < 0.3 THEN 'High Confidence - Stable Department' WHEN CV > 0.8 THEN 'Low Confidence - Highly Volatile' ELSE 'Medium Confidence' END AS Confidence_Band,
    CASE Recommended WHEN 'XGBOOST' THEN 'Stable department - ML can help' WHEN 'NAIVE' THEN 'Holiday-sensitive - Keep it simple' ELSE 'Borderline case - use ensemble' END AS Advice,
    Recommended || ' (Confidence: ' || CAST(ROUND(Confidence * 100) AS INTEGER) || '%)' AS Label FROM profile""")
def recommendation_advice(t):
    return profile.recommendation_advice(profile.confidence_band(t.profile)).select(
        "Store", "Dept", "Recommended", "Confidence_Band", "Advice", "Label"
    )


@query("MDL1 MDL2 MDL3 EVL10 RSH1 CLN2", """SELECT Store, Dept, Date, Actual, CASE WHEN Model = 'Simple Average' THEN ROUND(Predicted, 2) ELSE Predicted END AS Predicted, Model FROM predictions""")
def baseline_forecasts(t):
    mean = F.col("Model") == "Simple Average"
    return t.predictions.withColumn("Predicted", F.when(mean, F.round("Predicted", 2)).otherwise(F.col("Predicted")))


@query("MDL1", """SELECT Store, Dept, Date, Weekly_Sales AS Actual, COALESCE(CASE WHEN LAG(split) OVER w = 'test' THEN LAG(Weekly_Sales) OVER w END,
    MAX_BY(CASE WHEN split <> 'test' THEN Weekly_Sales END, CASE WHEN split <> 'test' THEN Date END) OVER (PARTITION BY Store, Dept)) AS Predicted, 'Naive' AS Model
    FROM split WINDOW w AS (PARTITION BY Store, Dept ORDER BY Date) QUALIFY split = 'test'""")
def naive_forecast_bridged(t):
    return baselines.baseline_forecasts(t.split, models=("Naive",), bridge="val")


@query("MDL3 MDL2", """SELECT Store, Dept, Date, Weekly_Sales AS Actual, ROUND(m, 2) AS Predicted, 'Seasonal Naive' AS Model FROM (
    SELECT *, AVG(Weekly_Sales) FILTER (split = 'train') OVER (PARTITION BY Store, Dept) AS m FROM split) WHERE split = 'test'""")
def seasonal_naive_test_history(t):
    # The test part is shorter than a year, so the look-back inside it always falls through to the train mean.
    return rounded(baselines.baseline_forecasts(t.split, models=("Seasonal Naive",), history="test"), Predicted=2)


@query("WIN1 MDL1", "SELECT Store, Dept, Date, Weekly_Sales, LAG(Weekly_Sales) OVER (PARTITION BY Store, Dept ORDER BY Date) AS Naive FROM sales")
def naive_everywhere(t):
    return baselines.naive_everywhere(t.sales).select("Store", "Dept", "Date", "Weekly_Sales", "Naive")


@query("EVL3 EVL1 JN7", f"SELECT {_RESULT} FROM results")
def league_table(t):
    return rounded(t.results, **_RESULT_DIGITS)


@query("EVL3 SRT1", f"SELECT {_RESULT} FROM results")
def ranked_league(t):
    return rounded(evaluate.ranked_league(t.results), **_RESULT_DIGITS)


@query("EVL3 SRT1", """SELECT Store, Dept, Model, CAST(ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY MAPE,
    CASE Model WHEN 'Naive' THEN 1 WHEN 'Simple Average' THEN 5 WHEN 'Seasonal Naive' THEN 6 ELSE 9 END) AS INTEGER) AS Place FROM results""")
def league_places(t):
    """The place of each model in its series' league, so that the order itself is checked."""
    place = F.row_number().over(Window.partitionBy("Store", "Dept").orderBy("MAPE", combine.model_rank("Model")))
    return t.results.select("Store", "Dept", "Model", place.alias("Place"))


@query("EVL2", """SELECT Model, ROUND(AVG(ABS(Actual - Predicted)), 3) AS MAE, ROUND(AVG(ABS(Actual - Predicted) / GREATEST(ABS(Actual), 2.220446049250313e-16)), 8) AS MAPE_True,
    ROUND(1 - SUM((Actual - Predicted) ** 2) / (VAR_POP(Actual) * COUNT(*)), 8) AS R2 FROM predictions GROUP BY 1""")
def regression_quality(t):
    return rounded(evaluate.regression_quality(t.predictions, ("Model",)), MAE=3, MAPE_True=8, R2=8)


@query("EVL4 WIN8 JN11", f"SELECT {_RESULT} FROM best")
def best_models(t):
    return rounded(evaluate.best_models(t.results), **_RESULT_DIGITS)


@query("EVL4 AGG16", "SELECT Model, COUNT(*) AS Count, ROUND(COUNT(*) * 100::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS Percentage FROM best GROUP BY 1")
def best_model_wins(t):
    return rounded(evaluate.win_counts(t.results), Percentage=6)


_NAIVE_BEST = """(SELECT n.Store, n.Dept, n.MAPE AS Naive_MAPE, b.Model AS Best_Model, b.MAPE AS Best_MAPE, n.MAPE <= b.MAPE * 1.05::DOUBLE AS Naive_Wins,
    (n.MAPE - b.MAPE) / b.MAPE * 100 AS Improvement_Needed FROM results n JOIN best b ON n.Store = b.Store AND n.Dept = b.Dept WHERE n.Model = 'Naive')"""


@query("EVL5 JN6 WIN7", f"""SELECT Store, Dept, ROUND(Naive_MAPE, 6) AS Naive_MAPE, Best_Model, ROUND(Best_MAPE, 6) AS Best_MAPE, Naive_Wins,
    ROUND(Improvement_Needed, 6) AS Improvement_Needed FROM {_NAIVE_BEST}""")
def naive_close_to_best(t):
    return rounded(evaluate.naive_vs_best(t.results), Naive_MAPE=6, Best_MAPE=6, Improvement_Needed=6)


@query("EVL5", f"""SELECT COUNT(*) FILTER (Naive_Wins) AS Naive_Wins, COUNT(*) AS Series, ROUND(COUNT(*) FILTER (Naive_Wins) * 100::DOUBLE / COUNT(*), 6) AS Win_Rate,
    ROUND(AVG(Improvement_Needed), 6) AS Avg_Improvement_Needed FROM {_NAIVE_BEST}""")
def naive_close_summary(t):
    return rounded(evaluate.naive_close_summary(evaluate.naive_vs_best(t.results)), Win_Rate=6, Avg_Improvement_Needed=6)


@query("EVL5 WIN7", "SELECT COUNT(*) FILTER (Model = 'Naive' AND MAPE <= m * 1.05::DOUBLE) AS Naive_Wins FROM (SELECT *, MIN(MAPE) OVER (PARTITION BY Store, Dept) AS m FROM results)")
def naive_wins_by_minimum(t):
    return evaluate.naive_wins_by_min(t.results)


@query("FLT6", f"SELECT Store, Dept, Best_Model, ROUND(Improvement_Needed, 6) AS Improvement_Needed FROM {_NAIVE_BEST} WHERE Improvement_Needed > 20 AND Naive_MAPE > 30")
def naive_clearly_worse(t):
    worse = evaluate.naive_vs_best(t.results).where("Improvement_Needed > 20 and Naive_MAPE > 30")
    return rounded(worse.select("Store", "Dept", "Best_Model", "Improvement_Needed"), Improvement_Needed=6)


@query("EVL6 JN10", """SELECT r.Store, r.Dept, r.Model, ROUND(r.MAPE, 6) AS MAPE, ROUND((n.MAPE - r.MAPE) / n.MAPE * 100, 6) AS Improvement
    FROM results r JOIN results n ON r.Store = n.Store AND r.Dept = n.Dept AND n.Model = 'Naive' WHERE r.Model <> 'Naive'""")
def improvement_over_naive(t):
    out = evaluate.improvement_over_naive(t.results)
    return rounded(out.select("Store", "Dept", "Model", "MAPE", "Improvement"), MAPE=6, Improvement=6)


@query("EVL7 JN11 MDL7", """SELECT r.Store, r.Dept, CASE WHEN IsH THEN 'Naive' ELSE 'Seasonal Naive' END AS Hybrid_Model, ROUND(r.MAPE, 6) AS Hybrid_MAPE,
    ROUND(b.MAPE, 6) AS Best_Individual_MAPE, b.Model AS Best_Individual_Model, ROUND(n.MAPE, 6) AS Naive_MAPE,
    ROUND((b.MAPE - r.MAPE) / b.MAPE * 100, 6) AS Improvement_vs_Best, ROUND((n.MAPE - r.MAPE) / n.MAPE * 100, 6) AS Improvement_vs_Naive
    FROM (SELECT Store, Dept, Recommended <> 'XGBOOST' AS IsH FROM judged) j JOIN results r ON r.Store = j.Store AND r.Dept = j.Dept AND r.Model = CASE WHEN IsH THEN 'Naive' ELSE 'Seasonal Naive' END
    JOIN best b ON b.Store = r.Store AND b.Dept = r.Dept JOIN results n ON n.Store = r.Store AND n.Dept = r.Dept AND n.Model = 'Naive'""")
def rule_hybrid_comparison(t):
    chosen = t.profile.select(
        "Store", "Dept", F.when(F.col("Recommended") != "XGBOOST", "Naive").otherwise("Seasonal Naive").alias("Model")
    )
    hybrid = t.results.join(chosen, ["Store", "Dept", "Model"]).select(
        "Store", "Dept", F.col("Model").alias("Model_Used"), F.col("MAPE").alias("Final_MAPE")
    )
    digits = {c: 6 for c in ("Hybrid_MAPE", "Best_Individual_MAPE", "Naive_MAPE", "Improvement_vs_Best", "Improvement_vs_Naive")}
    return rounded(evaluate.hybrid_comparison(hybrid, t.results), **digits)


@query("EVL8 JN5", """SELECT r.Store, r.Dept, ROUND(MAPE, 6) AS MAPE, ROUND(Avg_Sales, 3) AS Avg_Sales, "HolidayLift%", SeasonalRatio, CV, Recommended
    FROM results r JOIN profile p ON r.Store = p.Store AND r.Dept = p.Dept WHERE Model = 'Naive'""")
def accuracy_vs_character(t):
    return rounded(evaluate.accuracy_vs_character(t.results, t.profile), MAPE=6, Avg_Sales=3)


@query("EVL8", """SELECT ROUND(CORR(MAPE, "HolidayLift%"), 8) AS Corr_Lift, ROUND(CORR(MAPE, CV), 8) AS Corr_CV, ROUND(CORR(MAPE, Avg_Sales), 8) AS Corr_Volume
    FROM results r JOIN profile p ON r.Store = p.Store AND r.Dept = p.Dept WHERE Model = 'Naive'""")
def accuracy_correlations(t):
    out = evaluate.accuracy_correlations(evaluate.accuracy_vs_character(t.results, t.profile))
    return rounded(out, Corr_Lift=8, Corr_CV=8, Corr_Volume=8)


@query("EVL9 WIN9 AGG1", """WITH n AS (SELECT * FROM results WHERE Model = 'Naive'), b AS (SELECT * FROM n ORDER BY MAPE, Store, Dept LIMIT 1), w AS (SELECT * FROM n ORDER BY MAPE DESC, Store, Dept LIMIT 1),
    a AS (SELECT AVG(MAPE) AS m FROM n), g AS (SELECT AVG(MAPE) AS m FROM best)
    SELECT ROUND(a.m, 6) AS Avg_MAPE, b.Store AS Best_Store, b.Dept AS Best_Dept, ROUND(b.MAPE, 6) AS Best_MAPE, w.Store AS Worst_Store, w.Dept AS Worst_Dept,
    ROUND(w.MAPE, 6) AS Worst_MAPE, ROUND(g.m, 6) AS Best_Avg_MAPE, ROUND(a.m - g.m, 6) AS Potential_Improvement FROM a, b, w, g""")
def headline_kpis(t):
    digits = {c: 6 for c in ("Avg_MAPE", "Best_MAPE", "Worst_MAPE", "Best_Avg_MAPE", "Potential_Improvement")}
    return rounded(evaluate.headline_kpis(t.results), **digits)


@query("AGG20", """SELECT Model, round_even(AVG(MAPE), 2) AS Mean_MAPE, round_even(STDDEV_SAMP(MAPE), 2) AS Std_Dev, round_even(MIN(MAPE), 2) AS Best, round_even(MAX(MAPE), 2) AS Worst FROM results GROUP BY 1""")
def model_summary(t):
    return evaluate.model_summary(t.results)


@query("AGG20", "SELECT Store_Type, ROUND(AVG(MAPE), 6) AS Mean_MAPE, ROUND(STDDEV_SAMP(MAPE), 6) AS Std_MAPE, COUNT(*) AS Rows FROM results GROUP BY 1")
def error_by_store_type(t):
    return rounded(evaluate.by_store_type(t.results), Mean_MAPE=6, Std_MAPE=6)


@query("AGG19", """SELECT Store_Type, """ + ", ".join(f"ROUND(AVG(MAPE) FILTER (Model = '{m}'), 6) AS \"{m}\"" for m in ("Naive", "Simple Average", "Seasonal Naive")) + " FROM results GROUP BY 1")
def model_by_store_type(t):
    models = ["Naive", "Simple Average", "Seasonal Naive"]
    return round_columns(combine.pivot_mean(t.results, "Store_Type", "Model", models, "MAPE"), 6, *models)


@query("AGG25", """WITH quart AS (SELECT Model, quantile_cont(MAPE, 0.25) AS Q1, quantile_cont(MAPE, 0.5) AS Median, quantile_cont(MAPE, 0.75) AS Q3 FROM results GROUP BY 1),
f AS (SELECT r.*, Q1, Median, Q3, MAPE BETWEEN Q1 - 1.5::DOUBLE * (Q3 - Q1) AND Q3 + 1.5::DOUBLE * (Q3 - Q1) AS inside FROM results r JOIN quart USING (Model))
SELECT Model, ROUND(MAX(Q1), 6) AS Q1, ROUND(MAX(Median), 6) AS Median, ROUND(MAX(Q3), 6) AS Q3, ROUND(MIN(MAPE) FILTER (inside), 6) AS Lower_Whisker,
ROUND(MAX(MAPE) FILTER (inside), 6) AS Upper_Whisker, COUNT(*) FILTER (NOT inside) AS Outliers, COUNT(*) AS Count FROM f GROUP BY 1""")
def error_boxplot_by_model(t):
    from shelfcast.functions.quantiles import box_summary

    return round_columns(box_summary(t.results, "MAPE", ("Model",)), 6, "Q1", "Median", "Q3", "Lower_Whisker", "Upper_Whisker")


@query("SRT3 SRT4", f"""SELECT * FROM (SELECT 'best' AS Side, {_RESULT} FROM results ORDER BY results.MAPE, Store, Dept, Model LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'worst' AS Side, {_RESULT} FROM results ORDER BY results.MAPE DESC, Store, Dept, Model LIMIT 10)""")
def top_bottom_departments(t):
    ties = ("Store", "Dept", "Model")
    both = combine.stack_labelled({
        "best": combine.top_k(t.results, "MAPE", 10, largest=False, ties=ties),
        "worst": combine.top_k(t.results, "MAPE", 10, ties=ties),
    }, "Side")
    return rounded(both, **_RESULT_DIGITS)


@query("SRT4 SRT5", f"SELECT {_RESULT}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Model ORDER BY MAPE DESC, Store, Dept) AS rank FROM results) results WHERE rank <= 10")
def worst_per_model(t):
    return rounded(combine.top_k_per_group(t.results, ("Model",), "MAPE", 10, ties=("Store", "Dept")), **_RESULT_DIGITS)


@query("AGG21 AGG17 SNK5", """SELECT 'Total Departments' AS Metric, CAST(COUNT(DISTINCT Dept) AS DOUBLE) AS Value, NULL AS Text FROM results
    UNION ALL SELECT 'Total Series', CAST(COUNT(DISTINCT (Store, Dept)) AS DOUBLE), NULL FROM results
    UNION ALL SELECT 'Average MAPE', ROUND(AVG(MAPE), 4), NULL FROM results UNION ALL SELECT 'Best MAPE', ROUND(MIN(MAPE), 4), NULL FROM results
    UNION ALL SELECT 'Worst MAPE', ROUND(MAX(MAPE), 4), NULL FROM results
    UNION ALL SELECT 'Total Annual Sales', ROUND(AVG(w) * 52, 4), NULL FROM (SELECT SUM(Weekly_Sales) AS w FROM sales GROUP BY Date)
    UNION ALL SELECT 'Total Sales', ROUND(SUM(Weekly_Sales), 4), NULL FROM sales
    UNION ALL SELECT 'Most Common Best Model', NULL, Model FROM (SELECT Model FROM best GROUP BY 1 ORDER BY COUNT(*) DESC, Model LIMIT 1)""")
def summary_report(t):
    return rounded(aggregates.summary_report(t.results, t.sales), Value=4)


_IMPACT = "Store, Dept, ROUND(MAPE, 6) AS MAPE, ROUND(Avg_Weekly_Sales, 2) AS Avg_Weekly_Sales, CV, ROUND(Under_Forecast_Pct, 8) AS Under_Forecast_Pct, ROUND(Error_Dollars, 4) AS Error_Dollars, ROUND(Stockout_Cost, 4) AS Stockout_Cost, ROUND(Holding_Cost, 4) AS Holding_Cost, ROUND(Total_Impact, 4) AS Total_Impact"


def _impact_view(df):
    names = [c.split(" AS ")[-1] for c in _IMPACT.split(", ") if " AS " in c]
    return rounded(
        df.select("Store", "Dept", "CV", *names),
        MAPE=6, Avg_Weekly_Sales=2, Under_Forecast_Pct=8, Error_Dollars=4, Stockout_Cost=4, Holding_Cost=4, Total_Impact=4,
    )


@query("IMP1 JN5 JN7 PRJ4 CLN6", f"SELECT {_IMPACT} FROM impact")
def inventory_impact(t):
    return _impact_view(t.impact)


@query("IMP2 AGG1", """SELECT ROUND(SUM(Error_Dollars * Under_Forecast_Pct * 0.3::DOUBLE * 2.5::DOUBLE + Error_Dollars * (1 - Under_Forecast_Pct) * 0.2::DOUBLE), 3) AS Total_Impact,
    ROUND(SUM(Error_Dollars * Under_Forecast_Pct * 0.3::DOUBLE * 2.5::DOUBLE), 3) AS Stockout_Cost, ROUND(SUM(Error_Dollars * (1 - Under_Forecast_Pct) * 0.2::DOUBLE), 3) AS Holding_Cost,
    ROUND(SUM(Error_Dollars), 3) AS Error_Dollars FROM impact""")
def impact_totals_custom(t):
    custom = inventory.inventory_impact(t.results, t.sales, t.profile, profit_margin=0.3, holding_cost=0.2, stockout_penalty=2.5)
    return round_columns(inventory.impact_totals(custom), 3, "Total_Impact", "Stockout_Cost", "Holding_Cost", "Error_Dollars")


@query("IMP3 SRT3", f"SELECT {_IMPACT} FROM impact ORDER BY impact.Total_Impact DESC, Store, Dept LIMIT 10")
def top_impact(t):
    return _impact_view(combine.top_k(t.impact, "Total_Impact", 10, ties=("Store", "Dept")))


@query("IMP3 AGG30", """SELECT CAST(i AS INTEGER) AS Bin_Order, Volatility, ROUND(COALESCE(SUM(Total_Impact), 0), 4) AS Total_Impact, COUNT(Total_Impact) AS Dept_Count
    FROM (VALUES (0, 'Low', 0, 0.3), (1, 'Medium', 0.3, 0.6), (2, 'High', 0.6, 1), (3, 'Very High', 1, 1e300)) b(i, Volatility, lo, hi)
    LEFT JOIN impact ON CV > lo::DOUBLE AND CV <= hi::DOUBLE GROUP BY ALL""")
def impact_by_volatility(t):
    return rounded(inventory.impact_by_volatility(t.impact), Total_Impact=4)


@query("IMP4 JN6", """SELECT r.Store, r.Dept, ROUND(r.MAPE, 6) AS MAPE_Naive, ROUND(b.MAPE, 6) AS MAPE_Best, ROUND(r.MAPE / 100 * (Avg_Weekly_Sales * 52), 4) AS Current_Error,
    ROUND(b.MAPE / 100 * (Avg_Weekly_Sales * 52), 4) AS Best_Error, ROUND(r.MAPE / 100 * (Avg_Weekly_Sales * 52) - b.MAPE / 100 * (Avg_Weekly_Sales * 52), 4) AS Potential_Savings
    FROM results r JOIN best b ON r.Store = b.Store AND r.Dept = b.Dept JOIN means m ON m.Store = r.Store AND m.Dept = r.Dept WHERE r.Model = 'Naive'""")
def improvement_potential(t):
    out = inventory.improvement_potential(t.results, t.sales).drop("Avg_Weekly_Sales", "Annual_Sales")
    return rounded(out, MAPE_Naive=6, MAPE_Best=6, Current_Error=4, Best_Error=4, Potential_Savings=4)


_NEXT_WEEK = """(SELECT l.Store, l.Dept, Base_Value, Holiday_Next, Recommended, CV, lift, nd, Holiday_Next AND lift > -5 AS adj FROM (
    SELECT Store, Dept, MAX_BY(Weekly_Sales, Date) AS Base_Value, weekofyear(CAST(MAX(Date) + 7 AS DATE)) IN (44, 45) AS Holiday_Next, CAST(MAX(Date) + 7 AS DATE) AS nd FROM sales GROUP BY ALL) l
    JOIN (SELECT *, "HolidayLift%" AS lift FROM profile) p ON l.Store = p.Store AND l.Dept = p.Dept)"""


def _next_week(t):
    # The data ends in autumn, so the two weeks after it are declared holidays for this scenario.
    in_autumn = lambda d: F.weekofyear(d).isin(44, 45)
    scenarios = baselines.latest_scenarios(t.sales, in_autumn)
    return baselines.next_week_forecast(scenarios, t.profile, lift_threshold=-5.0)


@query("MDL11 PRF5 STR1 STR4", f"""SELECT Store, Dept, Base_Value, Holiday_Next, Recommended, ROUND(CASE WHEN adj THEN Base_Value * (1 + lift / 100) ELSE Base_Value END, 6) AS Predicted,
    CASE WHEN adj THEN 'Holiday Adjusted (+' || format('{{:.1f}}', lift) || '%)' WHEN Recommended IN ('XGBOOST', 'ENSEMBLE') THEN 'XGBoost' ELSE 'Naive Forecast (last week)' END AS Method,
    CASE WHEN CV < 0.3 THEN 'High' WHEN CV > 0.8 THEN 'Low' ELSE 'Medium' END AS Confidence_Level, adj AS Holiday_Alert FROM {_NEXT_WEEK}""")
def next_week_forecast(t):
    return rounded(_next_week(t), Predicted=6)


@query("MDL13 SET2 PRJ6 DT8", f"""SELECT Store, Dept, Date, Weekly_Sales, 'Historical' AS Type FROM sales
    UNION ALL SELECT Store, Dept, nd, ROUND(CASE WHEN adj THEN Base_Value * (1 + lift / 100) ELSE Base_Value END, 6), 'Forecast' FROM {_NEXT_WEEK}""")
def history_with_forecast(t):
    out = baselines.history_with_forecast(t.sales, _next_week(t))
    return out.withColumn("Weekly_Sales", F.when(F.col("Type") == "Forecast", F.round("Weekly_Sales", 6)).otherwise(F.col("Weekly_Sales")))
