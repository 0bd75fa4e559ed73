"""Sources and sinks: each query writes tables of the given folder below the shared checkpoint folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.names import FACTORS
from shelfcast.operators import cleaning, combine, features, learners, stored_trees
from shelfcast.session import ensure_checkpoint_dir
from shelfcast.sources import memo, readers, sinks
from shelfcast.sources.warehouse import TRAIN_END, VAL_END
from workload.model_queries import _GATED, SIZES, global_boosting, study_parts
from workload.registry import once, query, round_columns, rounded


def _folder(t) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


@query("SRC1 SNK1", "SELECT * FROM sales")
def csv_round_trip(t):
    path = f"{_folder(t)}/train.csv"
    sinks.write_csv(t.sales.select([f.name for f in schemas.SALES.fields]), path)
    return readers.read_csv(t.spark, path, schemas.SALES)


@query("SRC1 DT2", "SELECT Store, Date, Temperature, Fuel_Price, MarkDown1, MarkDown2, MarkDown3, MarkDown4, MarkDown5, CPI, Unemployment, IsHoliday FROM features")
def csv_with_other_dates(t):
    """Days first, slashes between; empty fields are NULL."""
    path = f"{_folder(t)}/features.csv"
    names = [f.name for f in schemas.FEATURES.fields]
    sinks.write_csv(t.features.select(names).withColumn("Date", F.date_format("Date", "dd/MM/yyyy")), path)
    return readers.read_csv(t.spark, path, schemas.FEATURES, "dd/MM/yyyy")


@query("SRC2", "SELECT 'present' AS Source, COUNT(*) AS Rows FROM stores UNION ALL SELECT 'absent', NULL")
def optional_source(t):
    base = _folder(t)
    sinks.write_table(t.stores, f"{base}/stores")
    there = readers.read_optional(readers.read_parquet, t.spark, f"{base}/stores")
    absent = readers.read_optional(readers.read_parquet, t.spark, f"{base}/no_such_table")
    count = there.agg(F.lit("present").alias("Source"), F.count(F.lit(1)).alias("Rows"))
    return count.union(t.spark.createDataFrame([("absent", None if absent is None else 0)], "Source string, Rows bigint"))


def _bundle(t):
    base = _folder(t)
    for name, table in (("fact", t.fact), ("results", t.results), ("profile", t.profile)):
        sinks.write_table(table, f"{base}/{name}")
    return readers.load_bundle(t.spark, base)


_BUNDLE = """SELECT 'fact' AS Name, COUNT(*) AS Rows, ROUND(SUM(Weekly_Sales), 2) AS Total FROM fact UNION ALL SELECT 'results', COUNT(*), ROUND(SUM(MAE), 2) FROM results
    UNION ALL SELECT 'profile', COUNT(*), ROUND(SUM(CV), 2) FROM profile"""


def _totals(bundle):
    parts = [("fact", bundle.fact, "Weekly_Sales"), ("results", bundle.results, "MAE"), ("profile", bundle.profile, "CV")]
    return combine.stack([df.agg(F.lit(n).alias("Name"), F.count(F.lit(1)).alias("Rows"), F.round(F.sum(c), 2).alias("Total")) for n, df, c in parts])


@query("SRC3", _BUNDLE)
def loaded_bundle(t):
    return _totals(_bundle(t))


@query("CACHE1", _BUNDLE)
def memoised_bundle(t):
    """The totals of a bundle that was memoised for a session and given up again."""
    bundle = _bundle(t).persist()
    rows = _totals(bundle).collect()
    bundle.unpersist()
    return t.spark.createDataFrame(rows, "Name string, Rows bigint, Total double")


@query("SNK2", "SELECT Store, Dept, ROUND(AVG(Weekly_Sales), 4) AS Mean FROM sales GROUP BY ALL")
def group_keys_in_csv(t):
    path = f"{_folder(t)}/means.csv"
    sinks.write_csv(rounded(t.sales.groupBy("Store", "Dept").agg(F.avg("Weekly_Sales").alias("Mean")), Mean=4), path)
    return t.spark.read.option("header", True).schema("Store int, Dept int, Mean double").csv(path)


@query("SNK3", "SELECT Kind, COUNT(*) AS Rows, Kind = 'one' AS One_File FROM results, (VALUES ('one'), ('parts')) v(Kind) GROUP BY ALL")
def exported_results(t):
    base, parts = _folder(t), []
    for kind, single in (("one", True), ("parts", False)):
        sinks.export_csv(t.results.repartition(3), f"{base}/{kind}", single_file=single)
        back = t.spark.read.option("header", True).csv(f"{base}/{kind}").withColumn("_file", F.input_file_name())
        parts.append(back.agg(F.lit(kind).alias("Kind"), F.count(F.lit(1)).alias("Rows"), (F.count_distinct("_file") == 1).alias("One_File")))
    return combine.stack(parts)


@query("SNK4 MDL5", """SELECT Store, Dept, COUNT(*) AS Weeks, TRUE AS Same FROM split WHERE split = 'test' AND (Store, Dept) IN (SELECT (Store, Dept) FROM split GROUP BY Store, Dept
  HAVING COUNT(*) >= 50 AND COUNT(*) FILTER (split = 'train') >= 20 AND COUNT(*) FILTER (split = 'val') >= 10 AND COUNT(*) FILTER (split = 'test') >= 10) GROUP BY ALL""")
def reloaded_model(t):
    """A saved and loaded model gives the scores it gave before."""
    path = f"{_folder(t)}/model"
    model, test = global_boosting(t), study_parts(t).where("split = 'test'")
    sinks.save_model(model, path)
    both = learners.score(sinks.load_pipeline(path), learners.score(model, test, out="_before"), out="_after")
    return both.groupBy("Store", "Dept").agg(F.count("_after").alias("Weeks"), F.every(F.col("_before") == F.col("_after")).alias("Same"))


@query("SNK4 CLN5", "SELECT p_partkey, CAST(DENSE_RANK() OVER (ORDER BY p_type) - 1 AS INTEGER) AS Type_Code FROM part")
def reloaded_encoder(t):
    path = f"{_folder(t)}/codes"
    parts = t.raw.table("part").select("p_partkey", "p_type")
    sinks.write_table(cleaning.label_codes(parts, "p_type", "Type_Code"), path)
    encoded, _ = cleaning.label_encode(parts, "p_type", "Type_Code", readers.read_parquet(t.spark, path))
    return encoded.select("p_partkey", "Type_Code")


def _stored_models(t):
    """The boosted trees and the forest of every series, fitted once, written and read back."""
    def make():
        path = f"{_folder(t)}/series_models"
        models = {"XGBoost": SIZES["basic"], "Random Forest": SIZES["forest"]}
        stored_trees.save_series_models(stored_trees.fit_series_models(study_parts(t), models, scale=True), path)
        return path

    return readers.read_parquet(t.spark, once(t, "stored series models", make))


@query("SNK4 MDL4 MDL5", f"""WITH {_GATED}
SELECT Store, Dept, Model, CASE Model WHEN 'XGBoost' THEN ROUND(AVG(Weekly_Sales), 4) ELSE 0::DOUBLE END AS Start, TRUE AS Whole
FROM gated, (VALUES ('XGBoost'), ('Random Forest')) m(Model) WHERE split = 'train' GROUP BY Store, Dept, Model""")
def stored_series_models(t):
    """A boosted model starts at the mean of its training weeks, a forest at 0; every tree is there, each child inside its tree."""
    trees = {"XGBoost": SIZES["basic"].trees, "Random Forest": SIZES["forest"].trees}
    wanted = F.element_at(F.create_map(*[F.lit(x) for item in trees.items() for x in item]), F.col("Model"))
    total = F.aggregate("Nodes", F.lit(0), lambda a, b: a + b)
    sizes = [F.size(c) == total for c in ("Feature", "Threshold", "Child", "Value")]
    largest = F.array_max("Child") < F.array_max("Nodes")
    whole = (F.col("Trees") == wanted) & (F.size("Nodes") == wanted) & sizes[0] & sizes[1] & sizes[2] & sizes[3] & largest
    return rounded(_stored_models(t).select("Store", "Dept", "Model", "Start", whole.alias("Whole")), Start=4)


@query("SNK4 FTR4", f"""WITH {_GATED}, long AS (
  SELECT Store, Dept, Feature, COALESCE(Value, 0) AS Value FROM (SELECT g.Store, g.Dept, g.Date, f.Temperature, f.Fuel_Price, f.CPI, f.Unemployment
    FROM gated g LEFT JOIN features f ON g.Store = f.Store AND g.Date = f.Date WHERE split = 'train' AND Weekly_Sales >= 0)
  UNPIVOT INCLUDE NULLS (Value FOR Feature IN (Temperature, Fuel_Price, CPI, Unemployment)))
SELECT Store, Dept, Model, Feature, ROUND(AVG(Value), 4) AS Mean, ROUND(CASE WHEN MIN(Value) < MAX(Value) THEN STDDEV_POP(Value) ELSE 1 END, 4) AS Scale
FROM long, (VALUES ('XGBoost'), ('Random Forest')) m(Model) GROUP BY ALL""")
def stored_series_scalers(t):
    """The scaler that every stored model carries, for the factor columns; missing values count as 0, as in the fit."""
    rows = _stored_models(t).select("Store", "Dept", "Model", F.inline(F.arrays_zip("Features", "Means", "Scales")))
    rows = rows.where(F.col("Features").isin(*FACTORS))
    return rounded(rows.select("Store", "Dept", "Model", F.col("Features").alias("Feature"), F.col("Means").alias("Mean"), F.col("Scales").alias("Scale")), Mean=4, Scale=4)


@query("SNK4 MDL4 MDL5 UDF4", f"""WITH {_GATED}
SELECT Store, Dept, Model, COUNT(*) AS Weeks, MIN(Date) AS First, MAX(Date) AS Last, TRUE AS Known, TRUE AS Inside
FROM gated, (VALUES ('XGBoost'), ('Random Forest')) m(Model) WHERE split = 'test' GROUP BY ALL""")
def reloaded_series_scores(t):
    """Test weeks scored by the models read back, without their sales; a forest stays in the range of its training weeks."""
    parts = study_parts(t)
    test = parts.where("split = 'test'").drop("Weekly_Sales")
    span = parts.where("split = 'train'").groupBy("Store", "Dept").agg(F.min("Weekly_Sales").alias("low"), F.max("Weekly_Sales").alias("top"))
    inside = (F.col("Model") != "Random Forest") | F.col("Predicted").between(F.col("low") - 1e-6, F.col("top") + 1e-6)
    found = stored_trees.score_series(test, _stored_models(t)).join(span, ["Store", "Dept"])
    return found.groupBy("Store", "Dept", "Model").agg(
        F.count("Predicted").alias("Weeks"), F.min("Date").alias("First"), F.max("Date").alias("Last"),
        F.every(F.col("Predicted").isNotNull()).alias("Known"), F.coalesce(F.every(inside), F.lit(False)).alias("Inside"),
    )


@query("SNK4 SRC6 DT8 UDF4", f"""WITH {_GATED}, ends AS (SELECT Store, Dept, MAX(Date) AS last FROM gated GROUP BY ALL)
SELECT Store, Dept, CAST(last + CAST(7 * k AS INTEGER) AS DATE) AS Date, Model, TRUE AS Known FROM ends, range(1, 9) r(k), (VALUES ('XGBoost'), ('Random Forest')) m(Model)""")
def coming_weeks_scored(t):
    """Eight weeks after each series' last one, which have no sales yet, under its stored models; the factors stay as they were."""
    parts = study_parts(t)
    factors = [c for c in learners.MODEL_FEATURES if c not in ("Store", "Dept")]
    last = combine.best_per_group(parts.select("Store", "Dept", "Date", *factors).withColumn("_age", -F.unix_date("Date")), "_age", ("Store", "Dept"), ties=["Date"])
    weeks = features.future_weeks(parts, 8).join(last.select("Store", "Dept", *factors), ["Store", "Dept"])
    return stored_trees.score_series(weeks, _stored_models(t)).select("Store", "Dept", "Date", "Model", F.col("Predicted").isNotNull().alias("Known"))


@query("SNK4 FTR4", """SELECT Store, Dept, Date, """ + ", ".join(
    f"ROUND(({c} - (SELECT AVG({c}) FROM fact WHERE Date < DATE '2000-01-01')) / (SELECT STDDEV_POP({c}) FROM fact WHERE Date < DATE '2000-01-01'), 6) AS {c}" for c in FACTORS) + """
FROM fact WHERE Date >= DATE '2001-01-01'""")
def reloaded_scaler(t):
    """The scaler of the training weeks, written, read back and applied to the test weeks."""
    path = f"{_folder(t)}/scaler"
    fact = features.label_split(t.fact, TRAIN_END, VAL_END)
    sinks.write_table(features.fit_scaler(fact.where("split = 'train'"), FACTORS), path)
    test = fact.where("split = 'test'").select("Store", "Dept", "Date", *FACTORS)
    return round_columns(features.apply_scaler(test, readers.read_parquet(t.spark, path), FACTORS), 6, *FACTORS)


@query("CACHE1", "SELECT Store, Dept, ROUND(AVG(Weekly_Sales), 4) AS Mean, 1 AS Made FROM sales GROUP BY ALL")
def remembered_means(t):
    """A table asked for twice is made once; the second time it is read from where the first one wrote it."""
    folder, made = _folder(t), []

    def make():
        made.append(1)
        return rounded(t.sales.groupBy("Store", "Dept").agg(F.avg("Weekly_Sales").alias("Mean")), Mean=4)

    inputs = [t.raw.path(name) for name in ("lineitem", "part", "supplier")]
    for _ in range(2):
        found = memo.remembered(t.spark, folder, "means", inputs, make, {"digits": 4})
    return found.withColumn("Made", F.lit(len(made)))
