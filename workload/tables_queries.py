"""Sources, cleaning, joins, features, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions import scalars
from shelfcast.names import FACTORS, MARKDOWNS
from shelfcast.operators import baselines, cleaning, combine, features
from shelfcast.sources import readers
from shelfcast.sources.search_interest import outer_join_terms
from shelfcast.sources.warehouse import TERMS
from workload.registry import query, round_columns, rounded


@query("SRC1 UDF2", "SELECT * FROM sales")
def weekly_sales_fact(t):
    return t.sales


@query("SRC1 JN1", "SELECT * FROM features")
def store_week_features(t):
    return t.features


@query("SRC1", "SELECT * FROM stores")
def store_dimension(t):
    return t.stores


@query("SRC1", """SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store, CAST(l_partkey % 50 AS INTEGER) AS item,
    CAST(SUM(l_quantity) AS BIGINT) AS sales FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def daily_demand(t):
    return t.raw.daily_demand()


@query("SRC4 JN4 RSH1 SET1", "SELECT * FROM search_wide")
def search_terms_pivot(t):
    return t.search_wide


@query("JN4", "SELECT * FROM search_wide")
def search_terms_outer_join(t):
    return outer_join_terms(t.raw.search_daily(), TERMS)


@query("FTR2 WIN2 DT6 DT7 PRJ2 SRT1", """SELECT Date, YearWeek, """ + ", ".join(
    f'ROUND("GoogleTrends_{x}{s}", 6) AS "GoogleTrends_{x}{s}"' for x in TERMS for s in ("", "_lag1", "_lag2", "_lag4")
) + " FROM trends")
def trend_weekly_lags(t):
    return round_columns(t.trends, 6, *combine.columns_containing(t.trends, "GoogleTrends"))


@query("FTR1 CLN8 JN1 JN2 CLN1 CLN5 FLT2", "SELECT * FROM fact")
def cleaned_fact(t):
    return t.fact


@query("FTR1 JN3 CLN2 PRJ7", """
WITH weeks AS (SELECT DISTINCT CAST(Date - CAST(dayofweek(Date) AS INTEGER) AS DATE) AS Date FROM fact),
filled AS (SELECT Date, """ + ", ".join(
    f'LAST_VALUE("GoogleTrends_{x}{s}" IGNORE NULLS) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS "GoogleTrends_{x}{s}"'
    for x in TERMS for s in ("", "_lag1", "_lag2", "_lag4")
) + """ FROM weeks FULL JOIN trends USING (Date))
SELECT f.*, strftime(f.Date, '%Y-%U') AS YearWeek, """ + ", ".join(
    f'ROUND("GoogleTrends_{x}{s}", 6) AS "GoogleTrends_{x}{s}"' for x in TERMS for s in ("", "_lag1", "_lag2", "_lag4")
) + """ FROM fact f LEFT JOIN filled w ON w.Date = CAST(f.Date - CAST(dayofweek(f.Date) AS INTEGER) AS DATE)""")
def enriched_fact(t):
    fact = features.build_fact(t.sales, t.features, t.stores, t.trends)
    return round_columns(fact, 6, *combine.columns_containing(fact, "GoogleTrends"))


@query("CLN7", """
WITH joined AS (SELECT s.Store, s.Dept, s.Date, s.Weekly_Sales, s.IsHoliday, f.* EXCLUDE (Store, Date, IsHoliday), t.Type, t.Size
  FROM sales s LEFT JOIN features f ON s.Store = f.Store AND s.Date = f.Date LEFT JOIN stores t ON s.Store = t.Store),
counts AS (SELECT COUNT(*) AS n, """ + ", ".join(f"COUNT(*) - COUNT({c}) AS {c}" for c in (
    "Store", "Dept", "Date", "Weekly_Sales", "IsHoliday", *FACTORS, *MARKDOWNS, "Type", "Size")) + """ FROM joined)
SELECT "column", missing, ROUND(missing * 100.0::DOUBLE / n, 6) AS percent FROM counts UNPIVOT (missing FOR "column" IN ("""
    + ", ".join(("Store", "Dept", "Date", "Weekly_Sales", "IsHoliday", *FACTORS, *MARKDOWNS, "Type", "Size")) + """)) WHERE missing > 0""")
def missing_report(t):
    joined = combine.join_stores(combine.join_features(t.sales, t.features), t.stores)
    return rounded(cleaning.missing_report(joined), percent=6)


@query("FLT2", "SELECT Store, Dept, Date, Weekly_Sales, IsHoliday FROM sales_net WHERE Weekly_Sales >= 0")
def nonnegative_sales(t):
    return cleaning.remove_negative(t.sales_net)


@query("CLN1 CLN3", """SELECT s.Store, s.Dept, s.Date, Weekly_Sales, """ + ", ".join(
    f"COALESCE({m}, 0.0) AS {m}" for m in MARKDOWNS) + """, Temperature FROM sales s JOIN features f
    ON s.Store = f.Store AND s.Date = f.Date WHERE Temperature IS NOT NULL""")
def filled_and_complete(t):
    joined = combine.join_features(t.sales, t.features)
    filled = cleaning.fill_constant(joined, MARKDOWNS)
    return cleaning.drop_incomplete(filled, ["Temperature"]).select(
        "Store", "Dept", "Date", "Weekly_Sales", *MARKDOWNS, "Temperature"
    )


@query("CLN2", """SELECT Store, Dept, Date, Temperature, LAST_VALUE(Temperature IGNORE NULLS) OVER (
    PARTITION BY Store, Dept ORDER BY Date ROWS UNBOUNDED PRECEDING) AS Filled FROM fact""")
def forward_filled_factor(t):
    base = t.fact.select("Store", "Dept", "Date", "Temperature", F.col("Temperature").alias("Filled"))
    return cleaning.forward_fill(base, ["Filled"])


@query("CLN4 CLN5 CLN6", """SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS Name_Number, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS Brand_Number,
    CAST(p_size > 25 AS INTEGER) AS Is_Large, GREATEST(0.3::DOUBLE, LEAST(0.7::DOUBLE, p_size / 50::DOUBLE)) AS Clipped FROM part""")
def coerced_columns(t):
    part = t.raw.table("part").select(
        "p_partkey",
        F.col("p_name").alias("Name_Number"),
        F.substring("p_brand", 7, 10).alias("Brand_Number"),
        (F.col("p_size") > 25).alias("Is_Large"),
        scalars.clip(F.col("p_size") / F.lit(50.0), 0.3, 0.7).alias("Clipped"),
    )
    return cleaning.bool_to_int(cleaning.coerce_double(part, ["Name_Number", "Brand_Number"]), ("Is_Large",))


@query("CLN5", """SELECT p_partkey, CAST(DENSE_RANK() OVER (ORDER BY p_type) - 1 AS INTEGER) AS Type_Code FROM part""")
def label_encoded(t):
    encoded, _ = cleaning.label_encode(t.raw.table("part").select("p_partkey", "p_type"), "p_type", "Type_Code")
    return encoded.select("p_partkey", "Type_Code")


@query("PRJ5", """SELECT 'IsHoliday_x=IsHoliday_y' AS pair, BOOL_AND(s.IsHoliday IS NOT DISTINCT FROM f.IsHoliday) AS equal
    FROM sales s LEFT JOIN features f ON s.Store = f.Store AND s.Date = f.Date""")
def duplicate_flag_agreement(t):
    """On all weeks: one without features holds no second flag, so there the two differ."""
    both = combine.join_features(t.sales, t.features, keep_both_flags=True)
    return cleaning.columns_agree(both, [("IsHoliday_x", "IsHoliday_y")])


@query("PRJ5", """SELECT s.Store, Dept, s.Date, Weekly_Sales, s.IsHoliday AS IsHoliday, Temperature FROM sales s LEFT JOIN features f ON s.Store = f.Store AND s.Date = f.Date""")
def coalesced_flag(t):
    both = combine.join_features(t.sales, t.features, keep_both_flags=True)
    return cleaning.coalesce_duplicate(both, "IsHoliday_x", "IsHoliday_y", "IsHoliday").select("Store", "Dept", "Date", "Weekly_Sales", "IsHoliday", "Temperature")


@query("PRJ1 PRJ2 PRJ3 PRJ4 PRJ6 MTH1 MTH2 MTH3 MTH4 CND2 STR1 STR4", """
SELECT Store, Dept AS Department, Date, 'Historical' AS Kind, ABS(Weekly_Sales - 1000) AS Distance, Weekly_Sales / 7 AS Per_Day,
  SQRT(Weekly_Sales) AS Root, LEAST(0.9::DOUBLE, Weekly_Sales / 100000) AS Capped, CASE WHEN IsHoliday THEN 'Holiday' ELSE 'Non-Holiday' END AS Flag,
  'S' || Store || 'D' || Dept AS Label FROM sales""")
def derived_columns(t):
    out = t.sales.select(
        "Store",
        F.col("Dept").alias("Department"),
        "Date",
        F.lit("Historical").alias("Kind"),
        F.abs(F.col("Weekly_Sales") - 1000).alias("Distance"),
        scalars.ratio("Weekly_Sales", F.lit(7)).alias("Per_Day"),
        F.sqrt("Weekly_Sales").alias("Root"),
        scalars.at_most(F.col("Weekly_Sales") / 100000, 0.9).alias("Capped"),
        F.when(F.col("IsHoliday"), "Holiday").otherwise("Non-Holiday").alias("Flag"),
        F.format_string("S%dD%d", "Store", "Dept").alias("Label"),
        "IsHoliday",
    )
    return combine.drop_columns(out, "IsHoliday", "No_Such_Column")


@query("STR4", """SELECT Store, Dept, Date, '$' || format('{:,}', CAST(CAST(FLOOR(Weekly_Sales) AS BIGINT) AS BIGINT)) AS Amount FROM sales""")
def money_labels(t):
    return t.sales.select("Store", "Dept", "Date", scalars.money(F.floor("Weekly_Sales")).alias("Amount"))


@query("STR4", """SELECT Store, Dept, Date, '$' || format('{:,}', CAST(round_even(CAST(Weekly_Sales AS DECIMAL(18,4)), 0) AS BIGINT)) AS Amount FROM sales""")
def rounded_money_labels(t):
    return t.sales.select("Store", "Dept", "Date", scalars.money("Weekly_Sales").alias("Amount"))


@query("STR2 STR3", """SELECT Store, Dept, Date, CAST(regexp_extract('Store ' || Store || ', Dept ' || Dept, 'Store ([0-9]+)', 1) AS INTEGER) AS Parsed_Store,
  contains('S' || Store, '1') AS Has_One FROM sales""")
def parsed_labels(t):
    label = F.format_string("Store %d, Dept %d", "Store", "Dept")
    return t.sales.select(
        "Store", "Dept", "Date",
        F.regexp_extract(label, "Store ([0-9]+)", 1).cast("int").alias("Parsed_Store"),
        F.concat(F.lit("S"), F.col("Store")).contains("1").alias("Has_One"),
    )


@query("DT1 DT2 DT3 DT4 DT5 DT6 DT7 DT8 DT9 DT10", """
SELECT d AS Day, CAST(year(d) AS INTEGER) AS Y, CAST(month(d) AS INTEGER) AS M, CAST(day(d) AS INTEGER) AS D, CAST(isodow(d) - 1 AS INTEGER) AS Weekday0,
  CAST(weekofyear(d) AS INTEGER) AS Iso_Week, strftime(d, '%Y-%U') AS Year_Week, CAST(d - CAST(dayofweek(d) AS INTEGER) AS DATE) AS Sunday,
  CAST(d + 7 AS DATE) AS Next_Week, strftime(d, '%Y-%m') AS Month_Label,
  strftime(date_trunc('week', d), '%Y-%m-%d') || '/' || strftime(date_trunc('week', d) + INTERVAL 6 DAY, '%Y-%m-%d') AS Week_Label,
  strftime(d, '%b') AS Month_Name, date_diff('day', DATE '1995-01-01', d) AS Days_Since, d AS Reparsed
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_functions(t):
    days = t.raw.table("orders").select(F.col("o_orderdate").cast("date").alias("Day")).distinct()
    return days.select(
        "Day",
        F.year("Day").alias("Y"),
        F.month("Day").alias("M"),
        F.dayofmonth("Day").alias("D"),
        cal.weekday_from_monday("Day").alias("Weekday0"),
        cal.iso_week("Day").alias("Iso_Week"),
        cal.year_week("Day").alias("Year_Week"),
        cal.week_sunday("Day").alias("Sunday"),
        F.date_add("Day", 7).alias("Next_Week"),
        cal.period_label("Day", "month").alias("Month_Label"),
        cal.period_label(cal.week_monday("Day"), "week").alias("Week_Label"),
        cal.month_name(F.month("Day")).alias("Month_Name"),
        F.datediff("Day", cal.parse_date(F.lit("1995-01-01"))).cast("bigint").alias("Days_Since"),
        cal.parse_date(F.date_format("Day", "dd/MM/yyyy"), "dd/MM/yyyy").alias("Reparsed"),
    )


@query("FLT1 FLT3 FLT4 FLT5 FLT7 FLT8", """SELECT * FROM sales WHERE Store IN (1, 2, 3, 5, 8) AND Dept IN (1, 4)
    AND Date BETWEEN DATE '1997-01-01' AND DATE '2000-06-30' AND NOT IsHoliday""")
def filtered_sales(t):
    some = t.raw.sales("1997-01-01", "2000-06-30", depts=[1, 4])
    return combine.apply_filters(some, "1997-01-01", "2000-06-30", stores=[1, 2, 3, 5, 8], depts=[1, 4], holiday=False)


@query("FLT1", "SELECT * FROM sales WHERE Store = 3 AND Dept = 2")
def one_series(t):
    return combine.apply_filters(t.raw.sales(depts=[2]), stores=[3], depts=[2])


@query("FLT9 SPL1", """SELECT * FROM split WHERE (Store, Dept) IN (SELECT (Store, Dept) FROM split GROUP BY Store, Dept
    HAVING COUNT(*) >= 50 AND COUNT(*) FILTER (split = 'train') >= 20 AND COUNT(*) FILTER (split = 'val') >= 10 AND COUNT(*) FILTER (split = 'test') >= 10)""")
def gated_series(t):
    return t.gated


@query("SPL1", "SELECT split, COUNT(*) AS Weeks, MIN(Date) AS First, MAX(Date) AS Last FROM split GROUP BY 1")
def chronological_split(t):
    return t.split.groupBy("split").agg(
        F.count(F.lit(1)).alias("Weeks"), F.min("Date").alias("First"), F.max("Date").alias("Last")
    )


@query("SPL2 AGG23", """WITH cut AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', Date) AS DOUBLE), 0.8) AS c FROM sales)
SELECT CASE WHEN date_diff('day', DATE '1970-01-01', Date) <= c THEN 'train' ELSE 'test' END AS split, COUNT(*) AS Weeks, MAX(Date) AS Last
FROM sales, cut GROUP BY 1""")
def quantile_split(t):
    return features.quantile_date_split(t.sales).groupBy("split").agg(
        F.count(F.lit(1)).alias("Weeks"), F.max("Date").alias("Last")
    )


@query("SPL3", """SELECT Store, Dept, Date, CASE WHEN CAST('0x' || substr(md5('42|' || Store || '|' || Dept || '|' || Date), 1, 8) AS BIGINT) % 100 < 80
    THEN 'train' ELSE 'test' END AS split FROM sales""")
def random_split(t):
    return features.hash_split(t.sales, ("Store", "Dept", "Date")).select("Store", "Dept", "Date", "split")


@query("SMP1", "SELECT * FROM sales ORDER BY md5('42|' || Store || '|' || Dept || '|' || Date), Store, Dept, Date LIMIT 1000")
def seeded_sample(t):
    return combine.fixed_sample(t.sales, 1000, ("Store", "Dept", "Date"))


@query("JN5 JN6", """SELECT a.Store, a.Dept, a.n AS Weeks_Gross, b.n AS Weeks_Net FROM (SELECT Store, Dept, COUNT(*) AS n FROM sales GROUP BY ALL) a
    JOIN (SELECT Store, Dept, COUNT(*) AS n FROM sales_net WHERE Weekly_Sales >= 0 GROUP BY ALL) b USING (Store, Dept)""")
def side_by_side_counts(t):
    count = lambda df: df.groupBy("Store", "Dept").agg(F.count(F.lit(1)).alias("Weeks"))
    return combine.measures_side_by_side(count(t.sales), count(cleaning.remove_negative(t.sales_net)), ["Weeks"], ("_Gross", "_Net"))


_HIGH = "(SELECT Store, Dept FROM levels WHERE Z_Score > 0.5)"


def _high(t):
    """Series that sell clearly more than the average one."""
    return t.levels.where("Z_Score > 0.5")


@query("JN8", f"SELECT * FROM sales WHERE (Store, Dept) IN (SELECT (Store, Dept) FROM {_HIGH})")
def jn8_semi_pairwise(t):
    return combine.keep_listed(t.sales, _high(t))


@query("JN8", f"SELECT * FROM sales WHERE Store IN (SELECT Store FROM {_HIGH}) AND Dept IN (SELECT Dept FROM {_HIGH})")
def jn8_semi_by_keys(t):
    return combine.keep_listed(t.sales, _high(t), pairwise=False)


@query("JN9", f"SELECT * FROM sales WHERE (Store, Dept) NOT IN (SELECT (Store, Dept) FROM {_HIGH})")
def jn9_anti_pairwise(t):
    return combine.drop_listed(t.sales, _high(t))


@query("JN9 FLT4", f"SELECT * FROM sales WHERE Store NOT IN (SELECT Store FROM {_HIGH}) OR Dept NOT IN (SELECT Dept FROM {_HIGH})")
def jn9_anti_by_keys(t):
    return combine.drop_listed(t.sales, _high(t), pairwise=False)


@query("JN12", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem")
def joined_by_row_id(t):
    """Two column sets of the lines put side by side by the position of the line in its table."""
    lines = readers.read_numbered(t.spark, t.raw.path("lineitem"))
    joined = combine.join_by_row_id(lines.select("row_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), lines.select("row_id", "l_discount"))
    return joined.drop("row_id")


@query("JN12", """SELECT CAST(COALESCE(p.n, o.n) - 1 AS BIGINT) AS row_id, p_partkey, p_type, o_orderkey, o_totalprice
    FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p_partkey) AS n FROM part) p FULL JOIN (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS n FROM orders) o ON p.n = o.n""")
def tables_side_by_side(t):
    """Parts and orders, both stored in the order of their keys, beside each other by position; there are more orders."""
    parts = readers.read_numbered(t.spark, t.raw.path("part")).select("row_id", "p_partkey", "p_type")
    orders = readers.read_numbered(t.spark, t.raw.path("orders")).select("row_id", "o_orderkey", "o_totalprice")
    return combine.side_by_side(parts, orders)


@query("SET1", """SELECT Store, Dept, Date, Weekly_Sales, NULL::DOUBLE AS Temperature FROM sales
    UNION ALL SELECT Store, NULL, Date, NULL, Temperature FROM features""")
def set1_union_by_name(t):
    return combine.stack([
        t.sales.select("Store", "Dept", "Date", "Weekly_Sales"),
        t.features.select("Store", "Date", "Temperature"),
    ])


@query("SET3", """SELECT Type, COUNT(*) AS Weeks, ROUND(SUM(Weekly_Sales), 4) AS Total FROM (
    SELECT 'Gross' AS Type, Weekly_Sales FROM sales UNION ALL SELECT 'Net', Weekly_Sales FROM sales_net) GROUP BY 1""")
def set3_labelled_stack(t):
    both = combine.stack_labelled({"Gross": t.sales, "Net": t.sales_net})
    return rounded(both.groupBy("Type").agg(F.count(F.lit(1)).alias("Weeks"), F.sum("Weekly_Sales").alias("Total")), Total=4)


@query("SET4 SRC5 SRT6", "SELECT DISTINCT Store, Dept FROM sales")
def series_list(t):
    return combine.distinct_sorted(t.sales, "Store", "Dept")


@query("SRT1 SRT2", "SELECT * FROM sales ORDER BY Date, Store, Dept LIMIT 25")
def head_preview(t):
    return t.sales.orderBy("Date", "Store", "Dept").limit(25)


@query("SRT2", "SELECT * FROM sales ORDER BY Date DESC, Store DESC, Dept DESC LIMIT 25")
def tail_preview(t):
    return t.sales.orderBy(F.desc("Date"), F.desc("Store"), F.desc("Dept")).limit(25)


@query("SRT3", "SELECT * FROM sales ORDER BY Weekly_Sales DESC, Store, Dept, Date LIMIT 10")
def top_weeks(t):
    return combine.top_k(t.sales, "Weekly_Sales", 10, ties=("Store", "Dept", "Date"))


@query("SRT5", """SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY Weekly_Sales DESC, Date) AS INTEGER) AS rank
    FROM sales QUALIFY rank <= 3""")
def top_weeks_per_series(t):
    return combine.top_k_per_group(t.sales, ("Store", "Dept"), "Weekly_Sales", 3, ties=("Date",))


@query("RSH1", "SELECT Store, Date, Feature, Value FROM features UNPIVOT INCLUDE NULLS (Value FOR Feature IN (Temperature, Fuel_Price, CPI, Unemployment))")
def rsh1_unpivot(t):
    return combine.melt(t.features, ["Store", "Date"], list(FACTORS), "Feature", "Value")


@query("RSH2", """SELECT Store, Size, CAST(Type = 'A' AS INTEGER) AS Type_A, CAST(Type = 'B' AS INTEGER) AS Type_B, CAST(Type = 'C' AS INTEGER) AS Type_C FROM stores""")
def rsh2_one_hot(t):
    return combine.one_hot(t.stores, "Type", ["A", "B", "C"])


@query("RSH2", """SELECT Store, Size, CAST(Type = 'B' AS INTEGER) AS Type_B, CAST(Type = 'C' AS INTEGER) AS Type_C FROM stores""")
def rsh2_one_hot_drop_first(t):
    return combine.one_hot(t.stores, "Type", ["A", "B", "C"], drop_first=True)


@query("WIN1 WIN3 FTR3 DT3 DT5 PRJ4", """SELECT Store, Dept, Date, Weekly_Sales, LAG(Weekly_Sales) OVER w AS Lag_1, LAG(Weekly_Sales, 4) OVER w AS Lag_4,
  ROUND(CASE WHEN COUNT(Weekly_Sales) OVER r = 4 THEN AVG(Weekly_Sales) OVER r END, 6) AS Rolling_Mean_4,
  CAST(month(Date) AS INTEGER) AS Month, CAST(weekofyear(Date) AS INTEGER) AS Week, Fuel_Price * IsHoliday AS Fuel_Holiday, CPI * IsHoliday AS CPI_Holiday FROM fact
  WINDOW w AS (PARTITION BY Store, Dept ORDER BY Date), r AS (PARTITION BY Store, Dept ORDER BY Date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def lag_rolling_features(t):
    return rounded(features.uplift_features(t.fact), Rolling_Mean_4=6).select(
        "Store", "Dept", "Date", "Weekly_Sales", "Lag_1", "Lag_4", "Rolling_Mean_4", "Month", "Week", "Fuel_Holiday", "CPI_Holiday"
    )


@query("WIN10", "SELECT Store, Dept, Date, CAST(ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY Date) - 1 AS INTEGER) AS t FROM sales")
def series_position(t):
    return features.series_index(t.sales).select("Store", "Dept", "Date", "t")


@query("WIN11", """SELECT Store, Dept, MAX_BY(Weekly_Sales, Date) AS Last_Train, MAX(Date) AS Last_Date FROM split WHERE split = 'train' GROUP BY ALL""")
def last_train_value(t):
    return baselines.last_train_value(t.split)


@query("WIN12 SET4", "SELECT * FROM sales QUALIFY ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY Date) = 1")
def first_week_per_series(t):
    return combine.first_per_group(t.sales, ("Store", "Dept"), ("Date",))


@query("FTR4", """SELECT Store, Dept, Date, """ + ", ".join(
    f"ROUND(({c} - (SELECT AVG({c}) FROM fact)) / (SELECT STDDEV_POP({c}) FROM fact), 6) AS {c}" for c in FACTORS) + " FROM fact")
def standardised_factors(t):
    base = t.fact.select("Store", "Dept", "Date", *FACTORS)
    return round_columns(features.standardise(base, FACTORS), 6, *FACTORS)


@query("SRC6 DT8", """SELECT Store, Dept, CAST(k AS INTEGER) AS step, CAST(last + CAST(7 * k AS INTEGER) AS DATE) AS Date
    FROM (SELECT Store, Dept, MAX(Date) AS last FROM sales GROUP BY ALL), range(1, 9) r(k)""")
def future_calendar(t):
    return features.future_weeks(t.sales, 8)


@query("AGG12 PRF4", """SELECT g.Store, g.Dept, CAST(g.d AS DATE) AS Date, COALESCE(s.Weekly_Sales, 0) AS Weekly_Sales FROM (
    SELECT Store, Dept, unnest(generate_series(MIN(Date), MAX(Date), INTERVAL 7 DAY)) AS d FROM sales GROUP BY Store, Dept) g
    LEFT JOIN sales s ON s.Store = g.Store AND s.Dept = g.Dept AND s.Date = g.d""")
def calendar_filled_sales(t):
    return features.fill_calendar(t.sales.drop("IsHoliday"))
