"""Registry of queries, and the shared SQL table expressions their checks are written on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import baselines, evaluate, features, inventory, outliers, profile
from shelfcast.sources.memo import content_key
from shelfcast.sources.search_interest import pivot_terms
from shelfcast.sources.warehouse import TERMS, TRAIN_END, VAL_END, Warehouse


class Tables:
    """The lazy tables of one data folder, as the queries use them."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.raw = Warehouse(spark, base)

    @cached_property
    def content(self) -> str:
        """A key of the folder's files as they are now."""
        return content_key(self.spark, [self.raw.base])

    @cached_property
    def sales(self) -> DataFrame:
        return self.raw.sales()

    @cached_property
    def sales_net(self) -> DataFrame:
        return self.raw.sales_net()

    @cached_property
    def features(self) -> DataFrame:
        return self.raw.features()

    @cached_property
    def stores(self) -> DataFrame:
        return self.raw.stores()

    @cached_property
    def search_wide(self) -> DataFrame:
        return pivot_terms(self.raw.search_daily(), TERMS)

    @cached_property
    def trends(self) -> DataFrame:
        return features.weekly_trends(self.search_wide, TERMS)

    @cached_property
    def fact(self) -> DataFrame:
        return features.build_fact(self.sales, self.features, self.stores)

    @cached_property
    def split(self) -> DataFrame:
        return features.label_split(self.sales, TRAIN_END, VAL_END)

    @cached_property
    def gated(self) -> DataFrame:
        return features.with_enough_history(self.split, 50, features.SPLIT_MINIMA)

    @cached_property
    def predictions(self) -> DataFrame:
        return baselines.baseline_forecasts(self.split, history="full")

    @cached_property
    def results(self) -> DataFrame:
        return evaluate.league_table(self.predictions, self.stores)

    @cached_property
    def profile(self) -> DataFrame:
        return profile.profile(self.fact)

    @cached_property
    def levels(self) -> DataFrame:
        return outliers.dept_outliers(self.sales)

    @cached_property
    def flagged(self) -> DataFrame:
        return outliers.weekly_outliers(self.fact)

    @cached_property
    def causes(self) -> DataFrame:
        return outliers.outlier_causes(self.fact)

    @cached_property
    def impact(self) -> DataFrame:
        return inventory.inventory_impact(self.results, self.sales, self.profile)


_ONCE: dict[tuple[str, str, str, str], object] = {}


def once(t: Tables, name: str, make: Callable[[], object]):
    """What several queries over one folder share (a written training table, a fitted model), made by the first of them.

    Kept for the life of the Spark application, and made again when a file of the folder changed.
    """
    key = (t.spark.sparkContext.applicationId, t.raw.base, t.content, name)
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    covers: tuple[str, ...]
    sql: str | None

    def __call__(self, spark: SparkSession, base: str) -> DataFrame:
        return self.build(Tables(spark, base))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a builder under its function name; ``covers`` lists the inventory ids it exercises."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = Query(key, build, tuple(covers.split()), with_tables(sql) if sql else None)
        return build

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round result columns so that the order of floating additions does not show."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def round_columns(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_MARKDOWNS = ", ".join(
    f"CAST(SUM(CASE WHEN o_orderpriority = '{p}' THEN CAST(o_totalprice AS DECIMAL(14,2)) END) AS DOUBLE) AS MarkDown{i}"
    for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), 1)
)
_FILLED = ", ".join(f"COALESCE(f.MarkDown{i}, 0.0) AS MarkDown{i}" for i in range(1, 6))
_TYPES = "['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD']"
_TERM_COLUMNS = ", ".join(
    f"CAST(NULLIF(COUNT(*) FILTER (o_orderpriority = '{p}'), 0) AS DOUBLE) AS {t}"
    for p, t in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), TERMS)
)
_TREND_MEANS = ", ".join(f'AVG({t}) AS "GoogleTrends_{t}"' for t in TERMS)
_TREND_LAGS = ", ".join(
    f'LAG("GoogleTrends_{t}", {k}) OVER (ORDER BY Date) AS "GoogleTrends_{t}_lag{k}"' for t in TERMS for k in (1, 2, 4)
)
_TREND_KNOWN = " AND ".join(
    [f'"GoogleTrends_{t}" IS NOT NULL' for t in TERMS]
    + [f'"GoogleTrends_{t}_lag{k}" IS NOT NULL' for t in TERMS for k in (1, 2, 4)]
)


def _weekly_sql(sign: str) -> str:
    return f"""
    SELECT s_nationkey AS Store, CAST(list_position({_TYPES}, p_type) AS INTEGER) AS Dept,
           CAST(date_trunc('week', l_shipdate) AS DATE) AS Date,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2)){sign}) AS DOUBLE) AS Weekly_Sales,
           weekofyear(CAST(date_trunc('week', l_shipdate) AS DATE)) IN (6, 36, 47, 52) AS IsHoliday
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY ALL"""


# name -> (tables it reads, SELECT)
TABLES_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "sales": ((), _weekly_sql("")),
    "sales_net": ((), _weekly_sql(" * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END")),
    "features": ((), f"""
    SELECT c_nationkey AS Store, CAST(date_trunc('week', o_orderdate) AS DATE) AS Date,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / COUNT(*) / 1000 AS Temperature,
           CAST(SUM(CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) / COUNT(*) / 1000 AS Fuel_Price,
           {_MARKDOWNS},
           CAST(COUNT(*) AS DOUBLE) AS CPI,
           CAST(COUNT(*) FILTER (o_orderstatus = 'F') * 100 AS DOUBLE) / COUNT(*) AS Unemployment,
           weekofyear(CAST(date_trunc('week', o_orderdate) AS DATE)) IN (6, 36, 47, 52) AS IsHoliday
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""),
    "stores": ((), """
    SELECT n_nationkey AS Store, ['A','B','C'][n_regionkey % 3 + 1] AS Type,
           CAST(COALESCE(n, 0) * 1000 AS BIGINT) AS Size
    FROM nation LEFT JOIN (SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey"""),
    "search_wide": ((), f"""
    SELECT CAST(o_orderdate AS DATE) AS date, {_TERM_COLUMNS} FROM orders GROUP BY 1"""),
    "trend_weeks": (("search_wide",), f"""
    SELECT CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS Date, {_TREND_MEANS} FROM search_wide GROUP BY 1"""),
    "trends": (("trend_weeks",), f"""
    SELECT Date, strftime(Date, '%Y-%U') AS YearWeek, * EXCLUDE (Date)
    FROM (SELECT *, {_TREND_LAGS} FROM trend_weeks) WHERE {_TREND_KNOWN}"""),
    "fact": (("sales", "features", "stores"), f"""
    SELECT s.Store, s.Dept, s.Date, s.Weekly_Sales, CAST(s.IsHoliday AS INTEGER) AS IsHoliday,
           f.Temperature, f.Fuel_Price, {_FILLED}, f.CPI, f.Unemployment, t.Type, t.Size
    FROM sales s LEFT JOIN features f ON s.Store = f.Store AND s.Date = f.Date LEFT JOIN stores t ON s.Store = t.Store
    WHERE s.Weekly_Sales >= 0"""),
    "split": (("sales",), """
    SELECT *, CASE WHEN Date < DATE '2000-01-01' THEN 'train' WHEN Date < DATE '2001-01-01' THEN 'val' ELSE 'test' END AS split
    FROM sales"""),
    "predictions": (("split",), """
    SELECT Store, Dept, Date, Actual, Predicted, Model FROM (
      SELECT Store, Dept, Date, Weekly_Sales AS Actual, COALESCE(prev, last_train) AS "Naive", train_mean AS "Simple Average",
             COALESCE(seasonal, LAST_VALUE(seasonal IGNORE NULLS) OVER (PARTITION BY Store, Dept ORDER BY Date ROWS UNBOUNDED PRECEDING), train_mean) AS "Seasonal Naive"
      FROM (
        SELECT *, CASE WHEN LAG(split) OVER w = 'test' THEN LAG(Weekly_Sales) OVER w END AS prev,
               LAG(Weekly_Sales, 52) OVER w AS seasonal,
               MAX_BY(CASE WHEN split = 'train' THEN Weekly_Sales END, CASE WHEN split = 'train' THEN Date END) OVER p AS last_train,
               AVG(CASE WHEN split = 'train' THEN Weekly_Sales END) OVER p AS train_mean
        FROM split WINDOW w AS (PARTITION BY Store, Dept ORDER BY Date), p AS (PARTITION BY Store, Dept)
      ) WHERE split = 'test'
    ) UNPIVOT INCLUDE NULLS (Predicted FOR Model IN ("Naive", "Simple Average", "Seasonal Naive"))"""),
    "results": (("predictions", "stores"), """
    SELECT p.Store, Dept, Type AS Store_Type, Model, MAE, RMSE, MAE / Avg_Sales * 100 AS MAPE, Avg_Sales FROM (
      SELECT Store, Dept, Model, AVG(ABS(Actual - Predicted)) AS MAE, SQRT(AVG((Actual - Predicted) ** 2)) AS RMSE, AVG(Actual) AS Avg_Sales
      FROM predictions WHERE Actual - Predicted IS NOT NULL GROUP BY ALL
    ) p LEFT JOIN stores USING (Store)"""),
    "best": (("results",), """
    SELECT * FROM results QUALIFY ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY MAPE,
      CASE Model WHEN 'Naive' THEN 1 WHEN 'Simple Average' THEN 5 WHEN 'Seasonal Naive' THEN 6 ELSE 9 END) = 1"""),
    "metrics": (("fact",), """
    SELECT Store, Dept, n AS DataPoints,
           CASE WHEN normal > 0 THEN (holiday / normal - 1) * 100 ELSE 0 END AS "HolidayLift%",
           CASE WHEN rest > 0 THEN season / rest ELSE 1 END AS SeasonalRatio,
           sd / NULLIF(mean, 0) AS CV, zeros * 100.0::DOUBLE / n AS ZeroPct,
           CASE WHEN n > 10 AND mean > 0 THEN ABS(slope) / mean * 100 ELSE 0 END AS TrendStrength,
           CASE WHEN promo_weeks > 0 AND no_promo > 0 THEN (promo / no_promo - 1) * 100 ELSE 0 END AS "PromoLift%"
    FROM (
      SELECT Store, Dept, COUNT(*) AS n, AVG(Weekly_Sales) AS mean, STDDEV_SAMP(Weekly_Sales) AS sd,
             AVG(Weekly_Sales) FILTER (IsHoliday = 1) AS holiday, AVG(Weekly_Sales) FILTER (IsHoliday = 0) AS normal,
             AVG(Weekly_Sales) FILTER (month(Date) IN (11, 12)) AS season, AVG(Weekly_Sales) FILTER (month(Date) NOT IN (11, 12)) AS rest,
             COUNT(*) FILTER (Weekly_Sales = 0) AS zeros, REGR_SLOPE(Weekly_Sales, t) AS slope,
             COUNT(*) FILTER (promoted) AS promo_weeks,
             AVG(Weekly_Sales) FILTER (promoted) AS promo, AVG(Weekly_Sales) FILTER (NOT promoted) AS no_promo
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY Date) - 1 AS t,
                   GREATEST(MarkDown1, MarkDown2, MarkDown3, MarkDown4, MarkDown5) > 0 AS promoted FROM fact)
      GROUP BY ALL) WHERE n >= 50"""),
    "judged": (("metrics",), """
    SELECT *, CASE WHEN ns > xs + 1 THEN 'NAIVE' WHEN xs > ns + 1 THEN 'XGBOOST' ELSE 'ENSEMBLE' END AS Recommended,
           CASE WHEN ns > xs + 1 THEN ns::DOUBLE / (ns + xs) WHEN xs > ns + 1 THEN xs::DOUBLE / (ns + xs) ELSE 0.5::DOUBLE END AS Confidence
    FROM (SELECT *,
      CASE WHEN "HolidayLift%" > 50 THEN 3 ELSE 0 END + CASE WHEN SeasonalRatio > 2 THEN 2 ELSE 0 END + CASE WHEN CV > 0.8 THEN 2 ELSE 0 END
      + CASE WHEN ZeroPct > 10 THEN 3 ELSE 0 END + CASE WHEN DataPoints < 100 THEN 2 ELSE 0 END + CASE WHEN "PromoLift%" > 30 THEN 1 ELSE 0 END AS ns,
      CASE WHEN DataPoints >= 100 THEN 2 ELSE 0 END + CASE WHEN CV < 0.5 THEN 2 ELSE 0 END
      + CASE WHEN "HolidayLift%" > 20 AND "HolidayLift%" < 50 THEN 1 ELSE 0 END + CASE WHEN TrendStrength > 1 THEN 1 ELSE 0 END
      + CASE WHEN ZeroPct < 1 THEN 1 ELSE 0 END AS xs FROM metrics)"""),
    "profile": (("judged",), """
    SELECT Store, Dept, Recommended, Confidence, DataPoints, round_even("HolidayLift%", 1) AS "HolidayLift%",
           round_even(SeasonalRatio, 2) AS SeasonalRatio, round_even(CV, 2) AS CV, round_even(ZeroPct, 1) AS ZeroPct,
           round_even("PromoLift%", 1) AS "PromoLift%" FROM judged"""),
    "levels": (("sales",), """
    SELECT *, ABS(Z_Score) > 2 AS Is_Outlier FROM (
      SELECT *, (Mean - AVG(Mean) OVER ()) / NULLIF(STDDEV_SAMP(Mean) OVER (), 0) AS Z_Score FROM (
        SELECT Store, Dept, round_even(AVG(Weekly_Sales), 2) AS Mean, round_even(STDDEV_SAMP(Weekly_Sales), 2) AS Std,
               CAST(round_even(CAST(MIN(Weekly_Sales) AS DECIMAL(18,4)), 2) AS DOUBLE) AS Min,
               CAST(round_even(CAST(MAX(Weekly_Sales) AS DECIMAL(18,4)), 2) AS DOUBLE) AS Max,
               COUNT(*) AS Weeks FROM sales GROUP BY ALL))"""),
    "flagged": (("fact",), """
    SELECT *, ABS(Weekly_Z_Dept) > 2 AS Is_Weekly_Outlier FROM (
      SELECT *, CASE WHEN STDDEV_SAMP(Weekly_Sales) OVER p > 0 THEN (Weekly_Sales - AVG(Weekly_Sales) OVER p) / STDDEV_SAMP(Weekly_Sales) OVER p ELSE 0 END AS Weekly_Z_Dept
      FROM fact WINDOW p AS (PARTITION BY Store, Dept))"""),
    "scored": (("flagged",), "SELECT *, " + ", ".join(
        f"CASE WHEN STDDEV_SAMP({f}) OVER s > 0 THEN ({f} - AVG({f}) OVER s) / STDDEV_SAMP({f}) OVER s ELSE 0 END AS {f}_Z"
        for f in ("Temperature", "Fuel_Price", "CPI", "Unemployment")
    ) + " FROM flagged WINDOW s AS (PARTITION BY Store)"),
    "causes": (("scored",), """
    SELECT *, CAST(month(Date) AS INTEGER) AS Month,
           CASE WHEN IsHoliday = 1 THEN 'Holiday-Driven' WHEN ABS(Fuel_Price_Z) > 2 THEN 'Fuel_Price Shock'
                WHEN ABS(CPI_Z) > 2 THEN 'CPI Shock' WHEN ABS(Unemployment_Z) > 2 THEN 'Unemployment Shock'
                WHEN month(Date) IN (11, 12) THEN 'Seasonal Peak' WHEN ABS(Temperature_Z) > 2 THEN 'Temperature Extreme'
                ELSE 'Unknown' END AS Cause
    FROM scored WHERE Is_Weekly_Outlier"""),
    "means": (("sales",), "SELECT Store, Dept, AVG(Weekly_Sales) AS Avg_Weekly_Sales FROM sales GROUP BY ALL"),
    "impact": (("results", "means", "profile"), """
    SELECT *, Stockout_Cost + Holding_Cost AS Total_Impact FROM (
      SELECT *, Error_Dollars * Under_Forecast_Pct * 0.25::DOUBLE * 2 AS Stockout_Cost,
             Error_Dollars * (1 - Under_Forecast_Pct) * 0.25::DOUBLE AS Holding_Cost
      FROM (SELECT r.Store, r.Dept, MAPE, Avg_Weekly_Sales, Avg_Weekly_Sales * 52 AS Annual_Sales, MAPE / 100 * (Avg_Weekly_Sales * 52) AS Error_Dollars,
                   COALESCE(CV, 0.5::DOUBLE) AS CV, GREATEST(0.3::DOUBLE, LEAST(0.7::DOUBLE, 0.3::DOUBLE + COALESCE(CV, 0.5::DOUBLE) * 0.4::DOUBLE)) AS Under_Forecast_Pct
            FROM results r JOIN means m ON r.Store = m.Store AND r.Dept = m.Dept
            LEFT JOIN profile p ON r.Store = p.Store AND r.Dept = p.Dept WHERE Model = 'Naive'))"""),
}


def with_tables(body: str) -> str:
    """Put the shared table expressions a statement names in front of it."""
    import re

    needed: list[str] = []

    def visit(name: str) -> None:
        for dep in TABLES_SQL[name][0]:
            visit(dep)
        if name not in needed:
            needed.append(name)

    for name in TABLES_SQL:
        if re.search(rf"(?i)\b(from|join)\s+{name}\b", body):
            visit(name)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({TABLES_SQL[n][1]})" for n in needed)
    if re.match(r"(?i)\s*with\s", body):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^\s*with\s", "", body, count=1)
    return f"WITH {ctes}\n{body}"
