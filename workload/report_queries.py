"""The tables behind dashboards and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.quantiles import box_summary, exact_quantiles, few_groups, histogram
from shelfcast.names import FACTORS, MARKDOWNS
from shelfcast.operators import aggregates, combine, outliers, profile
from shelfcast.plans import pages
from shelfcast.sources.readers import Bundle
from workload.registry import query, round_columns, rounded



def _few_types(t):
    """Sales rows take their type from the store dimension, so its distinct types bound the groups."""
    return few_groups(t.stores, ("Type",))


@query("AGG1 AGG23", """SELECT ROUND(SUM(Weekly_Sales), 4) AS Total, ROUND(AVG(Weekly_Sales), 2) AS Mean, MIN(Weekly_Sales) AS Min, MAX(Weekly_Sales) AS Max,
    ROUND(STDDEV_SAMP(Weekly_Sales), 4) AS Std, COUNT(*) AS Rows, ROUND(MEDIAN(Weekly_Sales), 6) AS Median FROM sales""")
def sales_kpis(t):
    return rounded(aggregates.global_kpis(t.sales), Total=4, Mean=2, Std=4, Median=6)


@query("AGG3 SRT1 WIN12", """SELECT Store, ROUND(SUM(Weekly_Sales), 4) AS Total_Sales, ROUND(AVG(Weekly_Sales), 2) AS Avg_Sales,
    COUNT(*) AS Num_Records, FIRST(Type) AS Type, FIRST(Size) AS Size FROM fact GROUP BY Store""")
def store_performance(t):
    return rounded(aggregates.store_performance(t.fact), Total_Sales=4, Avg_Sales=2)


@query("AGG4 CND2", """SELECT CASE WHEN IsHoliday THEN 'Holiday' ELSE 'Non-Holiday' END AS IsHoliday, ROUND(AVG(Weekly_Sales), 2) AS Mean,
    ROUND(SUM(Weekly_Sales), 4) AS Total, COUNT(*) AS Weeks FROM sales GROUP BY 1""")
def holiday_sales(t):
    return rounded(aggregates.holiday_sales(t.sales), Mean=2, Total=4)


@query("AGG5", "SELECT Date, ROUND(SUM(Weekly_Sales), 4) AS Weekly_Sales FROM sales GROUP BY 1")
def total_by_date(t):
    return rounded(aggregates.total_by_date(t.sales), Weekly_Sales=4)


@query("AGG6", "SELECT Date AS Period_Start, ROUND(SUM(Weekly_Sales), 4) AS Weekly_Sales, strftime(Date, '%Y-%m-%d') AS Period FROM sales GROUP BY 1")
def resample_day(t):
    return rounded(aggregates.resample(t.sales, "day"), Weekly_Sales=4)


_DEMAND = "(SELECT CAST(l_shipdate AS DATE) AS Date, SUM(l_quantity) AS sales FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


@query("AGG6 DT9", f"""SELECT 'day' AS Unit, Date AS Period_Start, CAST(sales AS BIGINT) AS sales, strftime(Date, '%Y-%m-%d') AS Period FROM {_DEMAND}
    UNION ALL SELECT 'week', CAST(date_trunc('week', Date) AS DATE), CAST(SUM(sales) AS BIGINT),
      strftime(date_trunc('week', Date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', Date) + INTERVAL 6 DAY, '%Y-%m-%d') FROM {_DEMAND} GROUP BY ALL""")
def resample_daily_demand(t):
    """Days and weeks differ here: demand is known by day."""
    demand = t.raw.daily_demand().withColumnRenamed("date", "Date")
    return combine.stack_labelled({u: aggregates.resample(demand, u, "sales") for u in ("day", "week")}, "Unit")


@query("AGG6 DT9", """SELECT CAST(date_trunc('week', Date) AS DATE) AS Period_Start, ROUND(SUM(Weekly_Sales), 4) AS Weekly_Sales,
    strftime(date_trunc('week', Date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', Date) + INTERVAL 6 DAY, '%Y-%m-%d') AS Period FROM sales GROUP BY ALL""")
def resample_week(t):
    return rounded(aggregates.resample(t.sales, "week"), Weekly_Sales=4)


@query("AGG6 DT9", """SELECT CAST(date_trunc('month', Date) AS DATE) AS Period_Start, ROUND(SUM(Weekly_Sales), 4) AS Weekly_Sales,
    strftime(Date, '%Y-%m') AS Period FROM sales GROUP BY ALL""")
def resample_month(t):
    return rounded(aggregates.resample(t.sales, "month"), Weekly_Sales=4)


@query("AGG7 DT10", """SELECT CAST(month(Date) AS INTEGER) AS Month, ROUND(AVG(Weekly_Sales), 2) AS Mean, COUNT(*) AS Weeks,
    strftime(MIN(Date), '%b') AS Month_Name FROM sales GROUP BY 1""")
def monthly_pattern(t):
    return rounded(aggregates.monthly_pattern(t.sales), Mean=2)


@query("AGG7 EDA2", """SELECT Store, Dept, CAST(month(Date) AS INTEGER) AS Month, ROUND(AVG(Weekly_Sales) * COUNT(*), 4) AS Total, COUNT(*) AS Weeks,
    strftime(MIN(Date), '%b') AS Month_Name FROM sales GROUP BY ALL""")
def monthly_pattern_by_series(t):
    # A month of one series has few weeks, so its mean may end exactly between two rounded values; mean * weeks does not.
    pattern = aggregates.monthly_pattern(t.sales, ("Store", "Dept"))
    return pattern.select("Store", "Dept", "Month", F.round(F.col("Mean") * F.col("Weeks"), 4).alias("Total"), "Weeks", "Month_Name")


@query("AGG7", """SELECT CAST(year(Date) AS INTEGER) AS Year, ROUND(SUM(Weekly_Sales), 4) AS Total, ROUND(AVG(Weekly_Sales), 2) AS Mean, COUNT(*) AS Weeks FROM sales GROUP BY 1""")
def yearly_totals(t):
    return rounded(aggregates.yearly_totals(t.sales), Total=4, Mean=2)


@query("AGG8", "SELECT store, ROUND(AVG(sales), 6) AS Mean FROM (SELECT s_nationkey AS store, CAST(SUM(l_quantity) AS BIGINT) AS sales FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE), l_partkey % 50) GROUP BY 1 ORDER BY AVG(sales) DESC, store LIMIT 20")
def top_stores_by_demand(t):
    return rounded(aggregates.top_means(t.raw.daily_demand(), "store", "sales"), Mean=6)


@query("AGG8", "SELECT item, ROUND(AVG(sales), 6) AS Mean FROM (SELECT CAST(l_partkey % 50 AS INTEGER) AS item, CAST(SUM(l_quantity) AS BIGINT) AS sales FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE), l_partkey % 50) GROUP BY 1 ORDER BY AVG(sales) DESC, item LIMIT 20")
def top_items_by_demand(t):
    return rounded(aggregates.top_means(t.raw.daily_demand(), "item", "sales"), Mean=6)


@query("AGG9 AGG10 MTH1", """SELECT Store, Dept, ROUND((AVG(Weekly_Sales) FILTER (IsHoliday) / NULLIF(AVG(Weekly_Sales) FILTER (NOT IsHoliday), 0) - 1) * 100, 6) AS Holiday_Lift,
    ROUND(AVG(Weekly_Sales) FILTER (month(Date) IN (11, 12)) / NULLIF(AVG(Weekly_Sales) FILTER (month(Date) NOT IN (11, 12)), 0), 8) AS Seasonal_Ratio FROM sales GROUP BY ALL""")
def lift_and_season(t):
    return rounded(aggregates.lift_and_season(t.sales), Holiday_Lift=6, Seasonal_Ratio=8)


@query("AGG11 AGG12 AGG33", """SELECT Store, Dept, COUNT(*) AS Weeks, ROUND(AVG(Weekly_Sales), 2) AS Mean, ROUND(MEDIAN(Weekly_Sales), 6) AS Median,
    ROUND(STDDEV_SAMP(Weekly_Sales), 6) AS Std, MIN(Weekly_Sales) AS Min, MAX(Weekly_Sales) AS Max, ROUND(STDDEV_SAMP(Weekly_Sales) / AVG(Weekly_Sales), 8) AS CV,
    COUNT(*) FILTER (Weekly_Sales = 0) AS ZeroWeeks, ROUND(COUNT(*) FILTER (Weekly_Sales = 0) * 100::DOUBLE / COUNT(*), 6) AS ZeroPct,
    ROUND(COUNT(*) FILTER (Weekly_Sales > 0) * 100::DOUBLE / COUNT(*), 6) AS SalesFrequency FROM sales GROUP BY ALL""")
def series_character(t):
    return rounded(profile.sales_character(t.sales), Mean=2, Median=6, Std=6, CV=8, ZeroPct=6, SalesFrequency=6)


@query("AGG14", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS MarkDown, COUNT(*) FILTER ({m} > 0) AS Weeks, ROUND(AVG(Weekly_Sales) FILTER ({m} > 0), 2) AS Promo_Sales,
    ROUND(AVG(Weekly_Sales) FILTER ({m} <= 0), 2) AS Normal_Sales,
    ROUND((AVG(Weekly_Sales) FILTER ({m} > 0) / NULLIF(AVG(Weekly_Sales) FILTER ({m} <= 0), 0) - 1) * 100, 6) AS "Lift%" FROM fact""" for m in MARKDOWNS) + ")")
def promo_by_markdown(t):
    return round_columns(rounded(profile.promo_by_markdown(t.fact), Promo_Sales=2, Normal_Sales=2), 6, "Lift%")


@query("AGG15 EDA5", """SELECT COUNT(DISTINCT Store) AS Distinct_Store, COUNT(DISTINCT Dept) AS Distinct_Dept, COUNT(DISTINCT (Store, Dept)) AS Series,
    COUNT(*) AS Rows FROM sales""")
def status_counts(t):
    return aggregates.status_counts(t.sales)


@query("AGG16", """SELECT p_type, COUNT(*) AS Count, ROUND(COUNT(*) * 100::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS Percentage FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def value_shares(t):
    lines = t.raw.table("lineitem").join(t.raw.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(aggregates.value_shares(lines, "p_type"), Percentage=6)


@query("AGG19", """SELECT CAST(month(Date) AS INTEGER) AS Month, """ + ", ".join(
    f"ROUND(AVG(Weekly_Sales) FILTER (year(Date) = {y}), 2) AS Y{y}" for y in range(1995, 2002)) + " FROM sales GROUP BY 1")
def month_year_pivot(t):
    years = range(1995, 2002)
    return round_columns(aggregates.month_year_pivot(t.sales, years), 2, *[f"Y{y}" for y in years])


@query("AGG22 AGG23", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std, MIN({c}) AS min,
    ROUND(quantile_cont({c}, 0.25), 6) AS p25, ROUND(quantile_cont({c}, 0.5), 6) AS p50, ROUND(quantile_cont({c}, 0.75), 6) AS p75, MAX({c}) AS max FROM fact"""
    for c in ("Weekly_Sales", *FACTORS)))
def describe_fact(t):
    d = aggregates.describe_table(t.fact, ["Weekly_Sales", *FACTORS])
    return rounded(d, mean=4, std=6, p25=6, p50=6, p75=6)


@query("AGG23", """SELECT Type, p AS prob, ROUND(q, 6) AS value, n FROM (
    SELECT Type, COUNT(*) AS n, unnest([0.01, 0.25, 0.5, 0.9, 0.99]::DOUBLE[]) AS p, unnest(quantile_cont(Weekly_Sales, [0.01, 0.25, 0.5, 0.9, 0.99])) AS q
    FROM fact GROUP BY Type)""")
def sales_quantiles_by_type(t):
    return rounded(exact_quantiles(t.fact, "Weekly_Sales", [0.01, 0.25, 0.5, 0.9, 0.99], ("Type",), few=_few_types(t)), value=6)


_HISTOGRAM = """WITH span AS (SELECT MIN({v}) AS lo, MAX({v}) AS hi FROM {src}),
bins AS (SELECT CAST(k AS INTEGER) AS bin, lo + k * ((hi - lo) / {n}::DOUBLE) AS bin_start, lo + (k + 1) * ((hi - lo) / {n}::DOUBLE) AS bin_end FROM span, range({n}) r(k)),
hits AS (SELECT CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR(({v} - lo) / ((hi - lo) / {n}::DOUBLE)) AS INTEGER), {n} - 1) END AS bin, COUNT(*) AS c FROM {src}, span WHERE {v} IS NOT NULL GROUP BY 1)
SELECT b.bin, ROUND(bin_start, {d}) AS bin_start, ROUND(bin_end, {d}) AS bin_end, COALESCE(c, 0) AS count FROM bins b LEFT JOIN hits USING (bin)"""


@query("AGG24", _HISTOGRAM.format(v="Weekly_Sales", src="sales", n=50, d=5))
def sales_histogram(t):
    return rounded(histogram(t.sales, "Weekly_Sales", 50), bin_start=5, bin_end=5)


@query("AGG24 IMP3", _HISTOGRAM.format(v="Total_Impact", src="impact", n=30, d=4))
def impact_histogram(t):
    return rounded(histogram(t.impact, "Total_Impact", 30), bin_start=4, bin_end=4)


@query("AGG24", _HISTOGRAM.format(v="MAPE", src="(SELECT * FROM results WHERE Model = 'Naive')", n=30, d=6))
def naive_error_histogram(t):
    return rounded(histogram(t.results.where("Model = 'Naive'"), "MAPE", 30), bin_start=6, bin_end=6)


_BOX = """WITH quart AS (SELECT {k}, quantile_cont({v}, 0.25) AS Q1, quantile_cont({v}, 0.5) AS Median, quantile_cont({v}, 0.75) AS Q3 FROM {src} GROUP BY {k}),
fenced AS (SELECT s.*, Q1, Median, Q3, {v} BETWEEN Q1 - 1.5::DOUBLE * (Q3 - Q1) AND Q3 + 1.5::DOUBLE * (Q3 - Q1) AS inside FROM {src} s JOIN quart USING ({k}))
SELECT {k}, ROUND(MAX(Q1), 6) AS Q1, ROUND(MAX(Median), 6) AS Median, ROUND(MAX(Q3), 6) AS Q3, ROUND(MIN({v}) FILTER (inside), 6) AS Lower_Whisker,
  ROUND(MAX({v}) FILTER (inside), 6) AS Upper_Whisker, COUNT(*) FILTER (NOT inside) AS Outliers, COUNT(*) AS Count FROM fenced GROUP BY {k}"""
_BOX_DIGITS = dict(Q1=6, Median=6, Q3=6, Lower_Whisker=6, Upper_Whisker=6)


@query("AGG25", _BOX.format(k="Type", v="Weekly_Sales", src="fact"))
def sales_boxplot_by_type(t):
    return rounded(box_summary(t.fact, "Weekly_Sales", ("Type",), few=_few_types(t)), **_BOX_DIGITS)


@query("AGG25 SET4", _BOX.format(k="Type", v="Size", src="stores"))
def size_boxplot_by_type(t):
    return rounded(box_summary(t.stores, "Size", ("Type",)), **_BOX_DIGITS)


@query("AGG25 OUT4", """WITH quart AS (SELECT Type, quantile_cont(Weekly_Sales, 0.25) AS Q1, quantile_cont(Weekly_Sales, 0.75) AS Q3 FROM fact GROUP BY Type)
SELECT Store, Dept, Date, Type, Weekly_Sales FROM fact JOIN quart USING (Type) WHERE NOT Weekly_Sales BETWEEN Q1 - 1.5::DOUBLE * (Q3 - Q1) AND Q3 + 1.5::DOUBLE * (Q3 - Q1)""")
def boxplot_points_by_type(t):
    return outliers.iqr_outliers_in_groups(t.fact, ("Type",), few=_few_types(t)).select("Store", "Dept", "Date", "Type", "Weekly_Sales")


@query("AGG26", "SELECT MIN(Date) AS First, MAX(Date) AS Last, CAST(date_diff('day', MIN(Date), MAX(Date)) AS INTEGER) AS Days FROM sales")
def date_extent(t):
    return aggregates.date_extent(t.sales)


@query("AGG27", """SELECT ROUND(Top, 4) AS Top, ROUND(Total, 4) AS Total, ROUND(Top / Total * 100, 6) AS Share FROM
    (SELECT SUM(Weekly_Sales) AS Top FROM (SELECT Weekly_Sales FROM sales ORDER BY 1 DESC LIMIT 100)), (SELECT SUM(Weekly_Sales) AS Total FROM sales)""")
def top_weeks_share(t):
    return rounded(aggregates.top_n_share(t.sales, "Weekly_Sales", 100), Top=4, Total=4, Share=6)


@query("AGG31", """SELECT Metric, ROUND(Mean, 6) AS Mean FROM (SELECT AVG("HolidayLift%") AS "HolidayLift%", AVG(CV) AS CV, AVG(ZeroPct) AS ZeroPct, AVG("PromoLift%") AS "PromoLift%" FROM metrics)
    UNPIVOT (Mean FOR Metric IN ("HolidayLift%", CV, ZeroPct, "PromoLift%"))""")
def metric_means(t):
    return rounded(aggregates.metric_means(profile.series_metrics(t.fact), ["HolidayLift%", "CV", "ZeroPct", "PromoLift%"]), Mean=6)


@query("WIN9 SRT3", """(SELECT 'lowest' AS Which, * FROM sales ORDER BY Weekly_Sales, Store, Dept, Date LIMIT 1)
    UNION ALL (SELECT 'highest', * FROM sales ORDER BY Weekly_Sales DESC, Store, Dept, Date LIMIT 1)""")
def extreme_weeks_overall(t):
    return aggregates.extreme_rows(t.sales, "Weekly_Sales", ("Store", "Dept", "Date"))


@query("EDA1", """SELECT 'rows' AS metric, '' AS "column", CAST(COUNT(*) AS VARCHAR) AS value FROM fact
  UNION ALL SELECT 'columns', '', '16' UNION ALL SELECT 'first', 'Date', CAST(MIN(Date) AS VARCHAR) FROM fact UNION ALL SELECT 'last', 'Date', CAST(MAX(Date) AS VARCHAR) FROM fact"""
    + "".join(f" UNION ALL SELECT 'missing', '{c}', CAST(COUNT(*) - COUNT({c}) AS VARCHAR) FROM fact" for c in (
        "Store", "Dept", "Date", "Weekly_Sales", "IsHoliday", *FACTORS, *MARKDOWNS, "Type", "Size"))
    + "".join(f" UNION ALL SELECT 'distinct', '{c}', CAST(COUNT(DISTINCT {c}) AS VARCHAR) FROM fact" for c in ("Store", "Dept", "Date", "IsHoliday", "Type", "Size"))
    + "".join(f" UNION ALL SELECT 'type', '{c}', '{k}'" for c, k in (
        ("Store", "int"), ("Dept", "int"), ("Date", "date"), ("Weekly_Sales", "double"), ("IsHoliday", "int"), *((c, "double") for c in (*FACTORS, *MARKDOWNS)),
        ("Type", "string"), ("Size", "bigint"))))
def fact_shape(t):
    return aggregates.profile_table(t.fact, ["Weekly_Sales", *FACTORS, *MARKDOWNS])


@query("EDA4 EDA1", """SELECT 'weekly' AS Dataset, COUNT(*) AS Rows, COUNT(DISTINCT (Store, Dept)) AS Series, MIN(Date) AS First, MAX(Date) AS Last,
    CAST(date_diff('day', MIN(Date), MAX(Date)) AS INTEGER) AS Days FROM sales
  UNION ALL SELECT 'daily', COUNT(*), COUNT(DISTINCT (store, item)), MIN(date), MAX(date), CAST(date_diff('day', MIN(date), MAX(date)) AS INTEGER) FROM (
    SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store, l_partkey % 50 AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""")
def dataset_comparison(t):
    return aggregates.compare_datasets({
        "weekly": (t.sales, "Date", ("Store", "Dept")),
        "daily": (t.raw.daily_demand(), "date", ("store", "item")),
    })


@query("EDA3 AGG7", """SELECT Store, Dept, CAST(year(Date) AS INTEGER) AS Year, ROUND(SUM(Weekly_Sales), 4) AS Total, COUNT(*) AS Weeks FROM sales GROUP BY ALL""")
def yearly_totals_by_series(t):
    yearly = aggregates.yearly_totals(t.sales, ("Store", "Dept"))
    return rounded(yearly.drop("Mean"), Total=4)


@query("EDA2 PRF5 PRF6 OUT1", """SELECT p.Store, p.Dept, p.Recommended, "HolidayLift%", CV, ZeroPct, Mean, ROUND(Z_Score, 8) AS Z_Score, Is_Outlier,
    CASE WHEN CV < 0.3 THEN 'High Confidence - Stable Department' WHEN CV > 0.8 THEN 'Low Confidence - Highly Volatile' ELSE 'Medium Confidence' END AS Confidence_Band
    FROM profile p LEFT JOIN levels l ON p.Store = l.Store AND p.Dept = l.Dept""")
def department_overview(t):
    bundle = Bundle(fact=t.fact, results=t.results, profile=t.profile)
    overview = pages.department_overview(bundle)
    return rounded(overview.select(
        "Store", "Dept", "Recommended", "HolidayLift%", "CV", "ZeroPct", "Mean", "Z_Score", "Is_Outlier", "Confidence_Band"
    ), Z_Score=8)


_CHOSEN = ((1, 1), (2, 3), (3, 2))


@query("EDA3 AGG19", "SELECT Date, " + ", ".join(
    f"MAX(CASE WHEN Store = {s} AND Dept = {d} THEN Weekly_Sales END) AS S{s}D{d}" for s, d in _CHOSEN)
    + f" FROM fact WHERE (Store, Dept) IN {_CHOSEN} GROUP BY Date")
def side_by_side_series(t):
    """The weeks of chosen series beside each other."""
    return pages.case_study(Bundle(t.fact, t.results, t.profile), _CHOSEN)["side_by_side"]
