"""Scans with explicit schemas; one place decides that a missing number is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schemas
from shelfcast.functions.calendar import parse_date


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark sorts NaN above every number and averages it to NaN; the analytics expect it to be missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, date_format: str | None = None
) -> DataFrame:
    """CSV with header; dates in another layout than ISO are named by ``date_format``."""
    options = {"header": True, "nanValue": "NaN", "nullValue": ""}
    if date_format:
        options["dateFormat"] = date_format
    paths = [path] if isinstance(path, str) else list(path)
    return nan_to_null(spark.read.options(**options).schema(schema).csv(paths))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


#: Most files whose offsets are sent to every task; a longer list is joined by shuffle.
FILES_TO_SEND = 50_000


def read_numbered(spark: SparkSession, path: str, row_id: str = "row_id") -> DataFrame:
    """A Parquet table with the position of every row, from 0: files in the order of their paths, rows as they stand in them.

    Nothing is sorted or shuffled: the scan knows a row's place in its file, and the rows of the files before are counted
    without reading a column. The numbers depend on the files alone, so a task that runs again gives the same ones.
    """
    table = spark.read.parquet(path)
    if row_id in table.columns:
        raise ValueError(f"the table has a column {row_id} already")
    found = F.col("_metadata.file_path").alias("_file")
    counted = table.select(found).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    if len(table.inputFiles()) <= FILES_TO_SEND:
        offsets = F.broadcast(offsets)
    placed = table.select("*", found, F.col("_metadata.row_index").alias("_row")).join(offsets, "_file")
    return nan_to_null(placed.select((F.col("_before") + F.col("_row")).alias(row_id), *table.columns))


def read_optional(reader, *args, **kwargs) -> DataFrame | None:
    """A source that may be absent: ``None`` when the path does not exist, other errors are raised."""
    try:
        return reader(*args, **kwargs)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass(frozen=True)
class Bundle:
    """The tables one analysis session works on; absent optional tables are ``None``."""

    fact: DataFrame
    results: DataFrame
    profile: DataFrame
    importance: DataFrame | None = None
    uplift: DataFrame | None = None
    uplift_by_series: DataFrame | None = None

    def register(self, prefix: str = "") -> list[str]:
        """Expose every present table as a temporary view for SQL users."""
        names = []
        for f in fields(self):
            table = getattr(self, f.name)
            if table is not None:
                table.createOrReplaceTempView(prefix + f.name)
                names.append(prefix + f.name)
        return names

    def persist(self) -> "Bundle":
        """Memoise the loaded tables for an interactive session."""
        for f in fields(self):
            table = getattr(self, f.name)
            if table is not None:
                table.persist()
        return self

    def unpersist(self) -> None:
        for f in fields(self):
            table = getattr(self, f.name)
            if table is not None:
                table.unpersist()


def load_bundle(spark: SparkSession, base: str) -> Bundle:
    """Load the session's tables from Parquet folders under ``base``."""
    at = lambda name: f"{base.rstrip('/')}/{name}"
    return Bundle(
        fact=read_parquet(spark, at("fact")),
        results=read_parquet(spark, at("results")),
        profile=read_parquet(spark, at("profile")),
        importance=read_optional(read_parquet, spark, at("importance")),
        uplift=read_optional(read_parquet, spark, at("uplift")),
        uplift_by_series=read_optional(read_parquet, spark, at("uplift_by_series")),
    )


def load_raw(spark: SparkSession, base: str, date_format: str | None = None) -> dict[str, DataFrame]:
    """The three raw CSV tables: weekly sales, store-week features, stores."""
    at = lambda name: f"{base.rstrip('/')}/{name}.csv"
    return {
        "sales": read_csv(spark, at("train"), schemas.SALES, date_format),
        "features": read_csv(spark, at("features"), schemas.FEATURES, date_format),
        "stores": read_csv(spark, at("stores"), schemas.STORES),
    }


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A table written by hand: scenarios, lookup texts, lists of series."""
    return spark.createDataFrame(list(rows), schema)


def reparse_dates(df: DataFrame, col: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    return df.withColumn(col, parse_date(col, fmt, strict))
