"""Fitted models. Their numbers have no SQL counterpart, except where the fitted parts are bypassed."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions import holidays
from shelfcast.names import FACTORS
from shelfcast.operators import arima_likelihood, baselines, binned_trees, combine, evaluate, explain, features, learners, series_fit, series_trees, trend_holidays, uplift
from shelfcast.session import cut_lineage
from shelfcast.sources.warehouse import TRAIN_END, VAL_END
from workload.registry import once, query, rounded


# The published settings, named here so that tests of plans and invariants can run on smaller ones.
SIZES = {
    "nuisance": uplift.NUISANCE, "causal": uplift.CAUSAL_FOREST, "what-if": learners.WHAT_IF, "global": learners.BASIC, "global forest": learners.GLOBAL_FOREST,
    "basic": learners.BASIC, "tuned": learners.TUNED, "early stop": learners.EARLY_STOPPED, "hybrid": learners.HYBRID, "forest": learners.SERIES_FOREST,
}


def study_parts(t):
    """The gated, labelled fact with the search-interest columns: written once, shared by every fit and baseline."""
    def make():
        fact = features.build_fact(t.sales, t.features, t.stores, t.trends)
        return cut_lineage(features.with_enough_history(features.label_split(fact, TRAIN_END, VAL_END), 50, features.SPLIT_MINIMA))

    return once(t, "parts", make)


def _with_trends(parts):
    return [*learners.MODEL_FEATURES, *combine.columns_containing(parts, "GoogleTrends")]


def _train(parts):
    return parts.where("split = 'train'")


def _test(parts):
    return parts.where("split = 'test'")


def global_boosting(t):
    """One model over all series, with store and department as features."""
    return once(t, "global boosting", lambda: learners.fit_boosting(_train(study_parts(t)), settings=SIZES["global"], written=True))


_FORM = ("Store", "Dept", "Date", "Actual", "Predicted", "Model")


@query("MDL5 EVL10 UDF4")
def gbt_forecast(t):
    return series_trees.series_models(study_parts(t), {"XGBoost": SIZES["basic"]}).select(*_FORM)


@query("MDL5 PRJ7 JN3")
def gbt_forecast_with_trends(t):
    parts = study_parts(t)
    return series_trees.series_models(parts, {"XGBoost Tuned": SIZES["tuned"]}, _with_trends(parts)).select(*_FORM)


@query("MDL5")
def gbt_forecast_early_stop(t):
    return series_trees.series_models(study_parts(t), {"XGBoost Early Stop": SIZES["early stop"]}).select(*_FORM, "Trees")


@query("MDL4 EVL10")
def rf_forecast(t):
    return series_trees.series_models(study_parts(t), {"Random Forest": SIZES["forest"]}).select(*_FORM)


@query("MDL4")
def global_rf_forecast(t):
    parts = study_parts(t)
    model = once(t, "global forest", lambda: learners.fit_forest(_train(parts), settings=SIZES["global forest"], written=True))
    return learners.predictions(model, _test(parts), "Random Forest")


@query("MDL5")
def global_gbt_forecast(t):
    return learners.predictions(global_boosting(t), _test(study_parts(t)), "XGBoost")


_SPAN = ("train", "val")


@query("MDL6 SET1 EVL3 EVL4 EDA2")
def full_league_table(t):
    """Nine models over every series, all on the same span up to the test part."""
    parts = study_parts(t)
    stacked = combine.stack([
        baselines.baseline_forecasts(parts, history="full", bridge="val", mean_of=_SPAN),
        series_trees.series_models(
            parts, {"XGBoost": SIZES["basic"], "Random Forest": SIZES["forest"]}, _with_trends(parts), _SPAN, ensemble="Ensemble"
        ).select(*_FORM),
        series_fit.arima_forecast(parts, fit_on=_SPAN),
        series_fit.seasonal_arima_forecast(parts, fit_on=_SPAN),
        series_fit.trend_season_forecast(parts, fit_on=_SPAN),
    ])
    return evaluate.league_table(stacked, t.stores)


def _ensemble(t):
    return series_trees.series_models(
        study_parts(t), {"XGBoost": SIZES["basic"], "Random Forest": SIZES["forest"]}, ensemble="Ensemble"
    )


@query("MDL6")
def ensemble_forecast(t):
    return _ensemble(t).where("Model = 'Ensemble'").select(*_FORM)


def _hybrid(t):
    """The learned model of the hybrid is fitted on the training part alone, so the validation part can judge it."""
    parts = study_parts(t)
    learned = series_trees.series_models(parts, {"XGBoost": SIZES["hybrid"]}, _with_trends(parts), predict_on=("val", "test"))
    scored = learned.withColumnRenamed("Actual", "Weekly_Sales").drop("Model", "Trees")
    return learners.hybrid_wide(parts, scored, t.profile)


@query("MDL7 EVL10 STR1")
def hybrid_forecast(t):
    return learners.hybrid_predictions(_hybrid(t))


@query("MDL7 EVL7")
def hybrid_results(t):
    return learners.hybrid_results(_hybrid(t))


# The selection rules alone, with a stand-in for the learned model (the train mean), are expressible in SQL.
@query("MDL7 MTH3", """
WITH learned AS (SELECT *, AVG(CASE WHEN split = 'train' THEN Weekly_Sales END) OVER (PARTITION BY Store, Dept) * 1.1::DOUBLE AS p FROM split),
gate AS (SELECT Store, Dept, COALESCE(AVG(ABS(Weekly_Sales - p)) FILTER (split = 'val') / AVG(Weekly_Sales) FILTER (split = 'val') * 100 < 50, FALSE) AS ok,
  LEAST(0.9::DOUBLE, STDDEV_SAMP(Weekly_Sales) FILTER (split = 'train') / AVG(Weekly_Sales) FILTER (split = 'train')) AS w FROM learned GROUP BY ALL),
naive AS (SELECT * FROM predictions WHERE Model = 'Naive')
SELECT n.Store, n.Dept, n.Date, n.Actual, CASE WHEN j.Recommended = 'NAIVE' OR NOT ok THEN 'NAIVE' ELSE j.Recommended END AS Model,
  CASE WHEN j.Recommended = 'NAIVE' OR NOT ok THEN Predicted WHEN j.Recommended = 'XGBOOST' THEN ROUND(p, 3) ELSE ROUND(w * Predicted + (1 - w) * p, 3) END AS Predicted
FROM naive n JOIN judged j ON n.Store = j.Store AND n.Dept = j.Dept JOIN gate g ON n.Store = g.Store AND n.Dept = g.Dept
JOIN learned l ON n.Store = l.Store AND n.Dept = l.Dept AND n.Date = l.Date""")
def hybrid_selection_rules(t):
    means = t.split.where("split = 'train'").groupBy("Store", "Dept").agg((F.avg("Weekly_Sales") * 1.1).alias("Predicted"))
    scored = t.split.where("split in ('val', 'test')").join(means, ["Store", "Dept"])
    wide = learners.hybrid_wide(t.split, scored, t.profile)
    learned = F.col("Model") != "NAIVE"
    return learners.hybrid_predictions(wide).withColumn(
        "Predicted", F.when(learned, F.round("Predicted", 3)).otherwise(F.col("Predicted"))
    )


@query("MDL8 UDF4")
def arima_forecast(t):
    return series_fit.arima_forecast(t.gated)


@query("MDL9 UDF4")
def seasonal_arima_forecast(t):
    return series_fit.seasonal_arima_forecast(t.gated)


@query("MDL10 UDF4")
def trend_season_forecast(t):
    return series_fit.trend_season_forecast(t.gated)


def _scenarios(t):
    """Next week of every series under a holiday and without, with each factor's last known value."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("Date"))).alias(c)
    last = study_parts(t).groupBy("Store", "Dept").agg(*[latest(c) for c in (*FACTORS, "Size")])
    return last.withColumn("IsHoliday", F.explode(F.array(F.lit(0), F.lit(1))))


@query("MDL12 SRC5")
def scenario_scoring(t):
    return learners.scenario_scores(global_boosting(t), _scenarios(t))


@query("XPL1 AGG28")
def model_importance(t):
    return explain.model_importance(t.spark, global_boosting(t), learners.MODEL_FEATURES)


@query("XPL2 XPL1")
def series_model_importance(t):
    return explain.with_store_type(series_trees.series_importance(study_parts(t), SIZES["basic"]), t.stores)


def _importance(t):
    return explain.permutation_importance(global_boosting(t), _test(study_parts(t)))


@query("XPL2")
def permutation_importance(t):
    return explain.with_store_type(_importance(t), t.stores)


@query("XPL3 AGG28")
def mean_permutation_importance(t):
    return explain.mean_importance(_importance(t))


_CORRELATION = "(SELECT Store, Dept, Feature, COALESCE(CASE WHEN isnan(r) THEN 0 ELSE ABS(r) END, 0) AS Importance FROM (SELECT Store, Dept, " + ", ".join(
    f"COALESCE(CORR({f}, Weekly_Sales), 0) AS {f}" for f in FACTORS) + f" FROM fact GROUP BY ALL) UNPIVOT (r FOR Feature IN ({', '.join(FACTORS)})))"


@query("XPL3 AGG27 SRT5", f"""WITH ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY Importance DESC, Feature) AS k FROM {_CORRELATION})
SELECT Store, Dept, COUNT(*) AS Features, MAX(CASE WHEN k = 1 THEN Feature END) AS Top_Feature, ROUND(MAX(Importance), 8) AS Top_Importance,
  ROUND(SUM(Importance) FILTER (k <= 2) / NULLIF(SUM(Importance), 0) * 100, 6) AS Top_Share FROM ranked GROUP BY ALL""")
def importance_page(t):
    importance = explain.correlation_importance(t.fact, FACTORS)
    return rounded(explain.importance_summary(importance, top_n=2), Top_Importance=8, Top_Share=6)


@query("AGG28 XPL3", f"SELECT Feature, ROUND(AVG(Importance), 8) AS Importance FROM {_CORRELATION} GROUP BY 1 ORDER BY AVG(Importance) DESC, Feature LIMIT 15")
def mean_factor_importance(t):
    return rounded(explain.mean_importance(explain.correlation_importance(t.fact, FACTORS)), Importance=8)


def _residuals(t):
    return once(t, "residuals", lambda: cut_lineage(uplift.cross_fit_residuals(uplift.uplift_rows(t.fact), settings=SIZES["nuisance"])))


def _uplift(t):
    def make():
        effects, model = uplift.causal_uplift(_residuals(t), settings=SIZES["causal"])
        return cut_lineage(effects), model

    return once(t, "uplift", make)


@query("UPL1 CLN3")
def dml_uplift(t):
    effects, _ = _uplift(t)
    return effects.select("Store", "Dept", "Date", *uplift.CONTROLS, "Weekly_Sales", "Holiday_Uplift")


@query("UPL1 XPL1")
def uplift_importance(t):
    _, model = _uplift(t)
    return explain.model_importance(t.spark, model, uplift.CONTROLS)


@query("UPL2")
def uplift_intervals(t):
    """Effect and interval of every row."""
    effects, _ = _uplift(t)
    return effects.select("Store", "Dept", "Date", "Holiday_Uplift", "Std_Error", "Lower", "Upper")


@query("UPL2")
def uplift_mean_interval(t):
    """The mean effect with the means of the rows' bounds."""
    effects, _ = _uplift(t)
    return uplift.mean_interval(effects)


@query("UPL2")
def average_holiday_effect(t):
    return uplift.average_effect(_residuals(t), cluster="Store")


@query("UPL3 AGG29")
def uplift_rollups(t):
    effects, _ = _uplift(t)
    return uplift.uplift_rollups(effects)


# Mean times rows: the mean of a single week may end exactly between two rounded values, the total does not.
@query("UPL3 AGG29", """SELECT Store, Dept, ROUND(AVG(Weekly_Sales) * COUNT(*), 4) AS Total, COUNT(*) AS Rows,
    CASE GROUPING(Store, Dept) WHEN 0 THEN 'Series' WHEN 1 THEN 'Store' WHEN 2 THEN 'Dept' ELSE 'All' END AS Level
    FROM sales WHERE IsHoliday GROUP BY GROUPING SETS ((Store, Dept), (Store), (Dept), ())""")
def holiday_sales_rollups(t):
    rollups = uplift.uplift_rollups(t.sales.where("IsHoliday"), "Weekly_Sales")
    return rollups.withColumn("Total", F.round(F.col("Weekly_Sales") * F.col("Rows"), 4)).drop("Weekly_Sales")


def _what_if(t):
    """(model, test rows) of the what-if study: one boosted model over all rows up to the date quantile."""
    def make():
        rows = cut_lineage(features.quantile_date_split(uplift.what_if_rows(t.fact)))
        model = learners.fit_second_order(rows.where("split = 'train'"), learners.UPLIFT_FEATURES, SIZES["what-if"])
        return model, rows.where("split = 'test'")

    return once(t, "what-if", make)


_WEEK = ("Store", "Dept", "Date")


@query("UPL4 SPL2 RSH2")
def whatif_uplift(t):
    model, test = _what_if(t)
    return uplift.what_if_uplift(model, test).select(
        "Store", "Dept", "Date", "With_Holiday", "Without_Holiday", "Holiday_Uplift"
    )


@query("EVL2 UPL4")
def whatif_model_quality(t):
    model, test = _what_if(t)
    return evaluate.regression_quality(
        learners.predictions(model, test, "XGBoost", learners.UPLIFT_FEATURES), ("Model",)
    )


@query("XPL4 JN12")
def shapley_values(t):
    model, test = _what_if(t)
    used = learners.UPLIFT_FEATURES
    return explain.shapley_with_features(binned_trees.tree_shapley(model, test, _WEEK), test, used)


# What every fitted model must satisfy, whatever its numbers; the right-hand sides need no model.
_GATED = """gated AS (SELECT * FROM split WHERE (Store, Dept) IN (SELECT (Store, Dept) FROM split GROUP BY Store, Dept
  HAVING COUNT(*) >= 50 AND COUNT(*) FILTER (split = 'train') >= 20 AND COUNT(*) FILTER (split = 'val') >= 10 AND COUNT(*) FILTER (split = 'test') >= 10))"""


@query("MDL4 UDF4", f"""WITH {_GATED}
SELECT Store, Dept, COUNT(*) AS Weeks, MIN(Date) AS First, MAX(Date) AS Last, ROUND(SUM(Weekly_Sales), 0) AS Actual, TRUE AS Inside
FROM gated WHERE split = 'test' GROUP BY ALL""")
def forest_stays_inside(t):
    """A forest's prediction is a mean of training values, so it lies in their range; one for each test week."""
    parts = study_parts(t)
    span = _train(parts).groupBy("Store", "Dept").agg(F.min("Weekly_Sales").alias("low"), F.max("Weekly_Sales").alias("high"))
    found = series_trees.series_models(parts, {"Random Forest": SIZES["forest"]}).join(span, ["Store", "Dept"])
    inside = F.col("Predicted").between(F.col("low") - 1e-6, F.col("high") + 1e-6)
    return found.groupBy("Store", "Dept").agg(
        F.count("Predicted").alias("Weeks"), F.min("Date").alias("First"), F.max("Date").alias("Last"),
        F.round(F.sum("Actual"), 0).alias("Actual"), F.coalesce(F.every(inside), F.lit(False)).alias("Inside"),
    )


@query("MDL6 UDF4", f"""WITH {_GATED}
SELECT Store, Dept, Date, 3::BIGINT AS Models, TRUE AS Is_Mean FROM gated WHERE split = 'test'""")
def ensemble_is_mean_of_parts(t):
    value = lambda m: F.max(F.when(F.col("Model") == m, F.col("Predicted")))
    off = F.abs(value("Ensemble") - (value("XGBoost") + value("Random Forest")) / 2)
    return _ensemble(t).groupBy("Store", "Dept", "Date").agg(F.count("Predicted").alias("Models"), (off < 1e-6).alias("Is_Mean"))


@query("MDL5 UDF4", f"""WITH {_GATED}
SELECT Store, Dept, Model, COUNT(*) AS Weeks, TRUE AS Trees_Fit FROM gated, (VALUES ('XGBoost'), ('XGBoost Tuned'), ('XGBoost Early Stop')) m(Model)
WHERE split = 'test' GROUP BY ALL""")
def boosting_variants_coverage(t):
    """Every variant predicts every test week; the plain ones keep all their trees, early stopping keeps at most its limit."""
    models = {"XGBoost": SIZES["basic"], "XGBoost Tuned": SIZES["tuned"], "XGBoost Early Stop": SIZES["early stop"]}
    most = F.element_at(F.create_map(*[F.lit(x) for n, m in models.items() for x in (n, m.trees)]), F.col("Model"))
    fits = F.when(F.col("Model") == "XGBoost Early Stop", F.col("Trees").between(1, most)).otherwise(F.col("Trees") == most)
    found = series_trees.series_models(study_parts(t), models)
    return found.groupBy("Store", "Dept", "Model").agg(F.count("Predicted").alias("Weeks"), F.every(fits).alias("Trees_Fit"))


@query("MDL8 MDL9 MDL10 UDF4", f"""WITH {_GATED}, long AS (SELECT Store, Dept, COUNT(*) FILTER (split = 'train') AS n, COUNT(*) FILTER (split = 'test') AS w FROM gated GROUP BY ALL)
SELECT Model, Status, COUNT(*) AS Series, CAST(SUM(w) AS BIGINT) AS Weeks FROM (
  SELECT 'ARIMA' AS Model, CASE WHEN n >= 10 THEN 'ok' ELSE 'too short' END AS Status, w FROM long
  UNION ALL SELECT 'SARIMA', CASE WHEN n - 53 >= 72 THEN 'ok' ELSE 'too short' END, w FROM long
  UNION ALL SELECT 'Prophet', CASE WHEN n >= 20 THEN 'ok' ELSE 'too short' END, w FROM long) GROUP BY ALL""")
def series_fit_status(t):
    parts = study_parts(t)
    return series_fit.fit_status(combine.stack([f(parts) for f in (series_fit.arima_forecast, series_fit.seasonal_arima_forecast, series_fit.trend_season_forecast)]))


_CHANGES = f"""{_GATED}, steps AS (SELECT Store, Dept, Date, Weekly_Sales AS y, Weekly_Sales - LAG(Weekly_Sales) OVER s AS w, ROW_NUMBER() OVER s AS i
  FROM gated WHERE split = 'train' WINDOW s AS (PARTITION BY Store, Dept ORDER BY Date)),
pairs AS (SELECT *, LAG(w) OVER (PARTITION BY Store, Dept ORDER BY Date) AS before FROM steps)"""


@query("MDL8 UDF4", f"""WITH {_CHANGES}, fixed AS (SELECT Store, Dept, COUNT(w) AS n, (0.75::DOUBLE * MAX(CASE WHEN i = 2 THEN w * w END) + SUM((w - 0.5::DOUBLE * before) ** 2)) / COUNT(w) AS v,
  ARG_MAX(w, Date) AS last, ARG_MAX(y, Date) AS level FROM pairs GROUP BY ALL),
ahead AS (SELECT Store, Dept, Date, ROW_NUMBER() OVER (PARTITION BY Store, Dept ORDER BY Date) AS h FROM gated WHERE split = 'test'),
spread AS (SELECT a.h, SUM((2 - POW(0.5::DOUBLE, b.h - 1)) ** 2) AS s FROM (SELECT DISTINCT h FROM ahead) a JOIN (SELECT DISTINCT h FROM ahead) b ON b.h <= a.h GROUP BY ALL)
SELECT Store, Dept, Date, ROUND(v, 2) AS Variance, ROUND(-0.5::DOUBLE * (n * (LN(2 * PI() * v) + 1) - LN(0.75::DOUBLE)), 4) AS Log_Likelihood,
  ROUND(level + last * (1 - POW(0.5::DOUBLE, h)), 2) AS Predicted, ROUND(SQRT(v * s), 2) AS Std_Error FROM fixed JOIN ahead USING (Store, Dept) JOIN spread USING (h)""")
def arima_at_fixed_coefficients(t):
    """The recursion at coefficients whose likelihood, forecasts and standard errors have a closed form."""
    fits = arima_likelihood.arima_fits(t.gated, at=(0.5, 0.0))
    weeks = fits.select("Store", "Dept", "Variance", "Log_Likelihood", F.inline(F.arrays_zip("Dates", "Predicted", "Std_Error")))
    return rounded(weeks.withColumnRenamed("Dates", "Date"), Variance=2, Log_Likelihood=4, Predicted=2, Std_Error=2)


@query("MDL8 UDF4", f"""WITH {_CHANGES}
SELECT Store, Dept, COUNT(*) AS Weeks, ROUND(-0.5::DOUBLE * COUNT(w) * (LN(2 * PI() * SUM(w * w) / COUNT(w)) + 1), 4) AS Plain_Likelihood, TRUE AS Not_Worse, TRUE AS Inside, TRUE AS Covers_Shock
FROM steps GROUP BY ALL""")
def arima_likelihood_gain(t):
    """The fit is at least as likely as a random walk; no week is known better than up to its own shock.

    Errors need not grow from week to week: with a moving average near -1 the level returns, and they level off.
    """
    plain = arima_likelihood.arima_fits(t.gated, at=(0.0, 0.0)).select("Store", "Dept", F.col("Log_Likelihood").alias("Plain_Likelihood"))
    covers = F.forall("Std_Error", lambda e: e >= F.sqrt("Variance") * (1 - 1e-9))
    fits = arima_likelihood.arima_fits(t.gated).select(
        "Store", "Dept", F.col("Weeks").cast("bigint").alias("Weeks"), "Log_Likelihood", ((F.abs("AR") < 1) & (F.abs("MA") < 1)).alias("Inside"), covers.alias("Covers_Shock"))
    both = fits.join(plain, ["Store", "Dept"]).withColumn("Not_Worse", F.col("Log_Likelihood") >= F.col("Plain_Likelihood") - 1e-6)
    return rounded(both.drop("Log_Likelihood"), Plain_Likelihood=4)


@query("MDL8 UDF4")
def arima_intervals(t):
    """Forecasts of each test week with their standard errors."""
    return arima_likelihood.likelihood_forecast(arima_likelihood.arima_fits(t.gated))


_HOLIDAYS = """years AS (SELECT y, make_date(y, m, 1) AS first, m, n, wd, Holiday FROM range(1990, 2030) r(y), (VALUES
    (1, 3, 1, 'Martin Luther King Jr. Day'), (2, 3, 1, 'Washington''s Birthday'), (5, -1, 1, 'Memorial Day'), (9, 1, 1, 'Labor Day'), (10, 2, 1, 'Columbus Day'), (11, 4, 4, 'Thanksgiving')) h(m, n, wd, Holiday)),
named AS (SELECT Holiday, CAST(CASE WHEN n > 0 THEN first + CAST((wd - isodow(first) + 7) % 7 + 7 * (n - 1) AS INTEGER)
      ELSE last_day(first) - CAST((isodow(last_day(first)) - wd + 7) % 7 AS INTEGER) END AS DATE) AS Day FROM years
  UNION ALL SELECT Holiday, make_date(y, m, d) FROM range(1990, 2030) r(y), (VALUES (1, 1, 'New Year''s Day'), (6, 19, 'Juneteenth'), (7, 4, 'Independence Day'), (11, 11, 'Veterans Day'), (12, 25, 'Christmas Day')) h(m, d, Holiday)
  WHERE Holiday <> 'Juneteenth' OR y >= 2021)"""


@query("MDL10 DT8", f"""WITH {_HOLIDAYS}, weeks AS (SELECT DISTINCT Date FROM sales)
SELECT Date, Holiday, Day FROM weeks JOIN named ON Day BETWEEN Date AND CAST(Date + 6 AS DATE)""")
def named_holiday_weeks(t):
    return holidays.holidays_of_weeks(t.sales)


def _trend_fits(t):
    return once(t, "trend fits", lambda: cut_lineage(trend_holidays.trend_fits(t.gated)))


@query("MDL10 UDF4")
def trend_changes(t):
    """Slope of each series' trend and its change at every possible day, mostly 0; per year, on the log of sales."""
    fits = _trend_fits(t).select("Store", "Dept", "Slope", F.inline(F.arrays_zip("Change_Days", "Changes")))
    return fits.withColumnsRenamed({"Change_Days": "Date", "Changes": "Change"})


@query("MDL10 UDF4")
def holiday_effects_by_name(t):
    return _trend_fits(t).select("Store", "Dept", F.explode("Effects").alias("Holiday", "Effect"))


@query("MDL10", f"""WITH {_GATED}, {_HOLIDAYS}, train AS (SELECT * FROM gated WHERE split = 'train'),
seen AS (SELECT Store, Dept, COUNT(DISTINCT Holiday) AS h FROM train JOIN named ON Day BETWEEN Date AND CAST(Date + 6 AS DATE) GROUP BY ALL)
SELECT t.Store, t.Dept, CAST(COUNT(*) AS INTEGER) AS Weeks, CAST(LEAST(25, FLOOR(COUNT(*) * 0.8) - 1) AS INTEGER) AS Possible_Changes, CAST(COALESCE(MAX(h), 0) AS INTEGER) AS Holidays, TRUE AS At_Optimum
FROM train t LEFT JOIN seen s ON t.Store = s.Store AND t.Dept = s.Dept GROUP BY ALL""")
def trend_fit_quality(t):
    """Each series has an effect for every holiday in its history, and its changes of slope are those of the optimum."""
    return _trend_fits(t).select(
        "Store", "Dept", "Weeks", F.size("Change_Days").alias("Possible_Changes"), F.size("Effects").alias("Holidays"), (F.col("Gap") < 1e-3).alias("At_Optimum"))


@query("MDL12", f"""WITH {_GATED}
SELECT DISTINCT Store, Dept, h AS IsHoliday, TRUE AS Scored FROM gated, (VALUES (0), (1)) v(h)""")
def scenario_coverage(t):
    scored = learners.scenario_scores(global_boosting(t), _scenarios(t))
    return scored.select("Store", "Dept", "IsHoliday", F.col("Predicted").isNotNull().alias("Scored"))


@query("XPL1 XPL2 UDF4", f"""WITH {_GATED}
SELECT DISTINCT Store, Dept, 8::BIGINT AS Features, TRUE AS Sums_Up FROM gated""")
def importance_shares(t):
    """The shares of a series' own model add up to 1, or are all 0."""
    found = series_trees.series_importance(study_parts(t), SIZES["basic"])
    total = F.sum("Importance")
    return found.groupBy("Store", "Dept").agg(F.count("Importance").alias("Features"), ((F.abs(total - 1) < 1e-9) | (total == 0)).alias("Sums_Up"))


_WHAT_IF = f"""lagged AS (SELECT *, LAG(Weekly_Sales, 4) OVER w AS lag4, LAG(Weekly_Sales) OVER w AS lag1 FROM fact WINDOW w AS (PARTITION BY Store, Dept ORDER BY Date)),
complete AS (SELECT * FROM lagged WHERE lag4 IS NOT NULL AND lag1 IS NOT NULL AND Temperature IS NOT NULL AND Fuel_Price IS NOT NULL AND CPI IS NOT NULL AND Unemployment IS NOT NULL AND Size IS NOT NULL),
cut AS (SELECT quantile_cont(epoch(CAST(Date AS TIMESTAMP)) / 86400, 0.8) AS last_day FROM complete)"""


@query("UPL4 XPL4", f"""WITH {_WHAT_IF}
SELECT Store, Dept, Date, TRUE AS Is_Difference FROM complete, cut WHERE epoch(CAST(Date AS TIMESTAMP)) / 86400 > last_day""")
def whatif_coverage(t):
    model, test = _what_if(t)
    found = uplift.what_if_uplift(model, test)
    off = F.abs(F.col("Holiday_Uplift") - (F.col("With_Holiday") - F.col("Without_Holiday")))
    return found.select("Store", "Dept", "Date", (off < 1e-9).alias("Is_Difference"))


@query("XPL4", f"""WITH {_WHAT_IF}
SELECT Store, Dept, COUNT(*) AS Rows, TRUE AS Adds_Up FROM complete, cut WHERE epoch(CAST(Date AS TIMESTAMP)) / 86400 > last_day GROUP BY ALL""")
def shapley_additivity(t):
    """A row's Shapley values add up to its prediction minus the mean one of the background rows."""
    model, test = _what_if(t)
    shap = binned_trees.tree_shapley(model, test, _WEEK)
    total = sum((F.col(f"Shap_{f}") for f in learners.UPLIFT_FEATURES[1:]), F.col(f"Shap_{learners.UPLIFT_FEATURES[0]}"))
    off = F.abs(total - (F.col("Predicted") - F.col("Baseline")))
    return shap.groupBy("Store", "Dept").agg(F.count(F.lit(1)).alias("Rows"), (F.max(off) < 1e-4).alias("Adds_Up"))


@query("UPL1", f"""WITH {_WHAT_IF}
SELECT Store, Dept, COUNT(*) AS Rows, COUNT(*) AS Known FROM complete GROUP BY ALL""")
def dml_coverage(t):
    effects, _ = _uplift(t)
    known = F.count_if(F.col("Holiday_Uplift").isNotNull() & ~F.isnan("Holiday_Uplift"))
    return effects.groupBy("Store", "Dept").agg(F.count(F.lit(1)).alias("Rows"), known.alias("Known"))


@query("UPL2", """WITH r AS (SELECT Store, Weekly_Sales - AVG(Weekly_Sales) OVER (PARTITION BY Store) AS y, IsHoliday - AVG(IsHoliday) OVER (PARTITION BY Store) AS t FROM fact),
e AS (SELECT SUM(y * t) / SUM(t * t) AS effect, SUM(t * t) AS info, COUNT(*) AS n FROM r),
m AS (SELECT SQRT(SUM(s * s)) AS root FROM (SELECT Store, SUM(t * (y - effect * t)) AS s FROM r, e GROUP BY Store))
SELECT ROUND(effect, 4) AS Effect, ROUND(root / info, 4) AS Std_Error, ROUND(effect - 1.96::DOUBLE * root / info, 3) AS Lower, ROUND(effect + 1.96::DOUBLE * root / info, 3) AS Upper, n AS Rows FROM e, m""")
def average_effect_of_plain_residuals(t):
    """The interval on residuals that need no model: what is left of sales and holidays within the store."""
    means = t.fact.groupBy("Store").agg(F.avg("Weekly_Sales").alias("_y"), F.avg("IsHoliday").alias("_t"))
    rest = t.fact.join(means, "Store").select(
        "Store", (F.col("Weekly_Sales") - F.col("_y")).alias("_y_res"), (F.col("IsHoliday") - F.col("_t")).alias("_t_res")
    )
    return rounded(uplift.average_effect(rest, cluster="Store"), Effect=4, Std_Error=4, Lower=3, Upper=3)


@query("UPL2", f"""WITH {_WHAT_IF}
SELECT Store, Dept, COUNT(*) AS Rows, TRUE AS Between, TRUE AS Symmetric FROM complete GROUP BY ALL""")
def uplift_interval_coverage(t):
    """Every effect lies in the middle of an interval that is not empty."""
    effects, _ = _uplift(t)
    middle = F.abs((F.col("Lower") + F.col("Upper")) / 2 - F.col("Holiday_Uplift")) <= 1e-6 * (1 + F.abs("Holiday_Uplift"))
    inside = (F.col("Lower") < F.col("Holiday_Uplift")) & (F.col("Holiday_Uplift") < F.col("Upper"))
    known = lambda c: F.coalesce(F.every(c), F.lit(False))
    return effects.groupBy("Store", "Dept").agg(F.count("Holiday_Uplift").alias("Rows"), known(inside).alias("Between"), known(middle).alias("Symmetric"))
