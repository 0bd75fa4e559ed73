"""Outliers, causes and factor tests."""

from __future__ import annotations


from shelfcast.names import FACTORS
from shelfcast.operators import combine, inventory, outliers
from workload.registry import query, round_columns, rounded


@query("AGG2 MTH2", "SELECT Store, Dept, Mean, Std, Min, Max, Weeks FROM levels")
def series_levels(t):
    return outliers.series_levels(t.sales)


@query("OUT1 WIN6 JN7", """SELECT l.Store, l.Dept, Mean, Std, Min, Max, Weeks, ROUND(Z_Score, 8) AS Z_Score, Is_Outlier, CV, "HolidayLift%", ZeroPct
    FROM levels l LEFT JOIN profile p ON l.Store = p.Store AND l.Dept = p.Dept""")
def dept_outliers(t):
    return rounded(outliers.dept_outliers(t.sales, t.profile), Z_Score=8)


@query("OUT2 WIN4 UDF1", "SELECT Store, Dept, Date, Weekly_Sales, ROUND(Weekly_Z_Dept, 8) AS Weekly_Z_Dept, Is_Weekly_Outlier FROM flagged")
def weekly_outliers(t):
    return rounded(t.flagged.select("Store", "Dept", "Date", "Weekly_Sales", "Weekly_Z_Dept", "Is_Weekly_Outlier"), Weekly_Z_Dept=8)


@query("OUT2", "SELECT COUNT(*) FILTER (Is_Weekly_Outlier) AS Weekly_Outliers, COUNT(*) AS Weeks, ROUND(COUNT(*) FILTER (Is_Weekly_Outlier) * 100::DOUBLE / COUNT(*), 6) AS Outlier_Rate FROM flagged")
def outlier_rate(t):
    return rounded(outliers.outlier_rate(t.flagged), Outlier_Rate=6)


@query("WIN5 UDF1", "SELECT Store, Dept, Date, " + ", ".join(f"ROUND({f}_Z, 6) AS {f}_Z" for f in FACTORS) + " FROM scored")
def factor_scores(t):
    scored = outliers.factor_scores(t.fact)
    return round_columns(scored.select("Store", "Dept", "Date", *[f"{f}_Z" for f in FACTORS]), 6, *[f"{f}_Z" for f in FACTORS])


@query("OUT3 AGG23", """SELECT Store, Dept, Date, Weekly_Sales, ROUND(q, 6) AS P90 FROM sales JOIN (SELECT Store, Dept, quantile_cont(Weekly_Sales, 0.9) AS q FROM sales GROUP BY ALL) USING (Store, Dept)
    WHERE Weekly_Sales > 1.5::DOUBLE * q""")
def extreme_weeks(t):
    weeks = outliers.extreme_weeks(t.sales, q=0.9, factor=1.5).withColumnRenamed("P99", "P90")
    return rounded(weeks.select("Store", "Dept", "Date", "Weekly_Sales", "P90"), P90=6)


@query("OUT3", """SELECT Store, Dept, Date, Weekly_Sales, ROUND(q, 6) AS P99 FROM sales JOIN (SELECT Store, Dept, quantile_cont(Weekly_Sales, 0.99) AS q FROM sales GROUP BY ALL) USING (Store, Dept)
    WHERE Weekly_Sales > 2 * q""")
def extreme_weeks_default(t):
    return rounded(outliers.extreme_weeks(t.sales).select("Store", "Dept", "Date", "Weekly_Sales", "P99"), P99=6)


@query("OUT4 AGG25", """SELECT Store, Dept, Date, Weekly_Sales, ROUND(Q1, 6) AS Q1, ROUND(Q3, 6) AS Q3 FROM sales JOIN (
    SELECT Store, Dept, quantile_cont(Weekly_Sales, 0.25) AS Q1, quantile_cont(Weekly_Sales, 0.75) AS Q3 FROM sales GROUP BY ALL) USING (Store, Dept)
    WHERE NOT Weekly_Sales BETWEEN Q1 - 1.5::DOUBLE * (Q3 - Q1) AND Q3 + 1.5::DOUBLE * (Q3 - Q1)""")
def iqr_outliers(t):
    return rounded(outliers.iqr_outliers(t.sales).select("Store", "Dept", "Date", "Weekly_Sales", "Q1", "Q3"), Q1=6, Q3=6)


@query("OUT5", """SELECT ROUND(m, 6) AS Mean, ROUND(s, 6) AS Std, ROUND(w, 6) AS Worst, ROUND(m + 3 * s, 6) AS Threshold, w > m + 3 * s AS Beyond_3_Sigma
    FROM (SELECT AVG(MAPE) AS m, STDDEV_SAMP(MAPE) AS s, MAX(MAPE) AS w FROM results WHERE Model = 'Naive')""")
def three_sigma_check(t):
    return rounded(outliers.three_sigma(t.results.where("Model = 'Naive'")), Mean=6, Std=6, Worst=6, Threshold=6)


@query("OUT6 CND1 WIN5 FLT5", "SELECT Store, Dept, Date, Weekly_Sales, Month, Cause FROM causes")
def outlier_causes(t):
    return t.causes.select("Store", "Dept", "Date", "Weekly_Sales", "Month", "Cause")


@query("OUT7 AGG16", "SELECT Cause, COUNT(*) AS Count, ROUND(COUNT(*) * 100::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS Percentage FROM causes GROUP BY 1")
def cause_distribution(t):
    return rounded(outliers.cause_distribution(t.causes), Percentage=6)


@query("OUT7 FLT8", """SELECT Cause, COUNT(*) AS Count, ROUND(COUNT(*) * 100::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS Percentage FROM causes
    WHERE Store IN (1, 2, 3, 4, 5, 6, 7, 8) GROUP BY 1""")
def cause_distribution_selected(t):
    return rounded(outliers.cause_distribution(t.causes, stores=list(range(1, 9)), depts=[]), Percentage=6)


@query("OUT7 AGG18 DT10", "SELECT Month, Cause, COUNT(*) AS Count, strftime(MIN(Date), '%b') AS Month_Name FROM causes GROUP BY ALL")
def cause_by_month(t):
    return outliers.cause_by_month(t.causes)


@query("JN13 STR3", "SELECT Cause, COUNT(*) AS Count, CAST(seq AS INTEGER) AS seq, advice FROM causes JOIN (VALUES "
    + ", ".join(f"('{c}', {i}, '{a}')" for c, i, a in combine.CAUSE_ADVICE) + ") v(Cause, seq, advice) USING (Cause) GROUP BY ALL")
def cause_advice(t):
    return outliers.advice_for_causes(t.causes, combine.cause_advice(t.spark))


@query("OUT8 AGG32 RSH1", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT Store, Dept, '{f}' AS Feature, '{label}' AS Week_Type, ROUND(AVG({f}) FILTER ({cond}), 3) AS Value FROM flagged GROUP BY Store, Dept
    HAVING COUNT(*) FILTER (Is_Weekly_Outlier) > 0 AND COUNT(*) FILTER (NOT Is_Weekly_Outlier) > 0"""
    for f in FACTORS for label, cond in (("Outlier Weeks", "Is_Weekly_Outlier"), ("Normal Weeks", "NOT Is_Weekly_Outlier"))) + ")")
def factor_comparison(t):
    return rounded(outliers.factor_comparison(t.flagged), Value=3)


_TTEST = "(" + " UNION ALL ".join(
    f"""SELECT Store, Dept, '{f}' AS Feature, COUNT({f}) FILTER (Is_Weekly_Outlier) AS a, COUNT({f}) FILTER (NOT Is_Weekly_Outlier) AS b,
    AVG({f}) FILTER (Is_Weekly_Outlier) AS ma, AVG({f}) FILTER (NOT Is_Weekly_Outlier) AS mb,
    VAR_SAMP({f}) FILTER (Is_Weekly_Outlier) AS va, VAR_SAMP({f}) FILTER (NOT Is_Weekly_Outlier) AS vb FROM flagged GROUP BY Store, Dept""" for f in FACTORS) + ")"


# The p-value is checked against a direct integration of the t density (Simpson's rule on the angle atan(t / sqrt(dof))).
@query("OUT9", f"""WITH sides AS (SELECT *, a + b - 2 AS dof, SQRT((COALESCE((a - 1) * va, 0) + COALESCE((b - 1) * vb, 0)) / NULLIF(a + b - 2, 0) * (1::DOUBLE / a + 1::DOUBLE / b)) AS scale
  FROM {_TTEST} WHERE a > 0 AND b > 0),
tests AS (SELECT *, CASE WHEN scale = 0 AND ma = mb THEN NULL WHEN scale = 0 THEN SIGN(ma - mb) * 'inf'::DOUBLE ELSE (ma - mb) / scale END AS ts FROM sides),
tails AS (SELECT *, list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(ATAN(ABS(ts) / SQRT(dof)) * k / 2000), dof - 1)))
    * ATAN(ABS(ts) / SQRT(dof)) / 6000 AS middle,
  list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(PI() / 2 * k / 2000), dof - 1))) * PI() / 12000 AS whole FROM tests)
SELECT Store, Dept, Feature, a AS "n_Outlier", b AS "n_Normal", dof AS "DoF", ROUND(ts, 6) AS "T_Statistic", ROUND(1 - middle / whole, 5) AS "P_Value",
  1 - middle / whole < 0.05 AS Significant FROM tails""")
def factor_ttest(t):
    return rounded(outliers.factor_ttest(t.flagged), T_Statistic=6, P_Value=5)


@query("OUT10 SMP1 AGG11", """SELECT Kind, Store, Dept, Mean, Std, ROUND(Std / Mean, 8) AS CV FROM (SELECT *, CASE WHEN Is_Outlier THEN 'Outlier Dept' ELSE 'Normal Dept' END AS Kind FROM levels)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY Kind ORDER BY md5('42|' || Store || '|' || Dept), Store, Dept) = 1""")
def outlier_contrast_sample(t):
    return rounded(outliers.contrast_sample(t.levels), CV=8)


@query("OUT10 SET3 AGG25", """WITH rows AS (SELECT CASE WHEN Is_Outlier THEN 'Outlier Dept' ELSE 'Normal Dept' END AS Type, Weekly_Sales FROM sales JOIN levels USING (Store, Dept)),
quart AS (SELECT Type, quantile_cont(Weekly_Sales, 0.25) AS Q1, MEDIAN(Weekly_Sales) AS Median, quantile_cont(Weekly_Sales, 0.75) AS Q3 FROM rows GROUP BY 1),
f AS (SELECT rows.*, Q1, Median, Q3, Weekly_Sales BETWEEN Q1 - 1.5::DOUBLE * (Q3 - Q1) AND Q3 + 1.5::DOUBLE * (Q3 - Q1) AS inside FROM rows JOIN quart USING (Type))
SELECT Type, ROUND(MAX(Q1), 6) AS Q1, ROUND(MAX(Median), 6) AS Median, ROUND(MAX(Q3), 6) AS Q3, MIN(Weekly_Sales) FILTER (inside) AS Lower_Whisker, MAX(Weekly_Sales) FILTER (inside) AS Upper_Whisker,
  COUNT(*) FILTER (NOT inside) AS Outliers, COUNT(*) AS Count FROM f GROUP BY 1""")
def outlier_contrast_boxes(t):
    from shelfcast.functions.quantiles import box_summary

    rows = outliers.kind_sales(t.sales, t.levels)
    return rounded(box_summary(rows, "Sales", ("Type",), few=True), Q1=6, Median=6, Q3=6)


@query("OUT10 SMP1 AGG25", """WITH picked AS (SELECT *, CASE WHEN Is_Outlier THEN 'Outlier Dept' ELSE 'Normal Dept' END AS Type FROM levels
    QUALIFY ROW_NUMBER() OVER (PARTITION BY Is_Outlier ORDER BY md5('42|' || Store || '|' || Dept), Store, Dept) = 1),
rows AS (SELECT Type, s.Store, s.Dept, s.Weekly_Sales FROM sales s JOIN picked p ON s.Store = p.Store AND s.Dept = p.Dept),
quart AS (SELECT Type, Store, Dept, quantile_cont(Weekly_Sales, 0.25) AS Q1, MEDIAN(Weekly_Sales) AS Median, quantile_cont(Weekly_Sales, 0.75) AS Q3 FROM rows GROUP BY ALL),
f AS (SELECT rows.*, Q1, Median, Q3, Weekly_Sales BETWEEN Q1 - 1.5::DOUBLE * (Q3 - Q1) AND Q3 + 1.5::DOUBLE * (Q3 - Q1) AS inside FROM rows JOIN quart USING (Type, Store, Dept))
SELECT Type, Store, Dept, ROUND(MAX(Q1), 6) AS Q1, ROUND(MAX(Median), 6) AS Median, ROUND(MAX(Q3), 6) AS Q3, MIN(Weekly_Sales) FILTER (inside) AS Lower_Whisker,
  MAX(Weekly_Sales) FILTER (inside) AS Upper_Whisker, COUNT(*) FILTER (NOT inside) AS Outliers, COUNT(*) AS Count FROM f GROUP BY ALL""")
def sampled_pair_boxes(t):
    """The distributions of the one outlying and the one normal department that were sampled."""
    from shelfcast.functions.quantiles import box_summary

    rows = outliers.sampled_sales(t.sales, t.levels)
    return rounded(box_summary(rows, "Sales", ("Type", "Store", "Dept"), few=True), Q1=6, Median=6, Q3=6)


@query("OUT3", """SELECT Store, Dept, Date, Weekly_Sales, ROUND(q, 6) AS P99 FROM sales JOIN (SELECT Store, Dept, quantile_cont(Weekly_Sales, 0.5) AS q FROM sales GROUP BY ALL) USING (Store, Dept)
    WHERE Weekly_Sales > 1.2::DOUBLE * q""")
def weeks_over_median(t):
    """Extreme weeks by a lower bar, which some weeks pass."""
    found = outliers.extreme_weeks(t.sales, q=0.5, factor=1.2)
    return rounded(found.select("Store", "Dept", "Date", "Weekly_Sales", "P99"), P99=6)


@query("AGG32 JN8 JN9", """SELECT ROUND(o, 4) AS Outlier_Avg, ROUND(n, 4) AS Normal_Avg, ROUND(o - n, 4) AS Difference FROM (
    SELECT AVG(Total_Impact) FILTER (Is_Outlier) AS o, AVG(Total_Impact) FILTER (NOT Is_Outlier) AS n FROM impact i JOIN levels l ON i.Store = l.Store AND i.Dept = l.Dept)""")
def impact_contrast(t):
    return round_columns(inventory.impact_contrast(t.impact, t.levels), 4, "Outlier_Avg", "Normal_Avg", "Difference")


@query("AGG32 JN8 JN9", """WITH odd AS (SELECT * FROM levels WHERE Is_Outlier), j AS (SELECT Total_Impact, Store IN (SELECT Store FROM odd) AND Dept IN (SELECT Dept FROM odd) AS o FROM impact)
SELECT ROUND(AVG(Total_Impact) FILTER (o), 4) AS Outlier_Avg, ROUND(AVG(Total_Impact) FILTER (NOT o), 4) AS Normal_Avg,
  ROUND(AVG(Total_Impact) FILTER (o) - AVG(Total_Impact) FILTER (NOT o), 4) AS Difference FROM j""")
def impact_contrast_by_keys(t):
    return round_columns(inventory.impact_contrast(t.impact, t.levels, pairwise=False), 4, "Outlier_Avg", "Normal_Avg", "Difference")
