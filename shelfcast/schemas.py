"""Explicit schemas of the input and league tables, so that no scan infers types."""

from pyspark.sql import types as T

SALES = T.StructType([
    T.StructField("Store", T.IntegerType()),
    T.StructField("Dept", T.IntegerType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Weekly_Sales", T.DoubleType()),
    T.StructField("IsHoliday", T.BooleanType()),
])

SALES_TEST = T.StructType([f for f in SALES.fields if f.name != "Weekly_Sales"])

FEATURES = T.StructType([
    T.StructField("Store", T.IntegerType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Temperature", T.DoubleType()),
    T.StructField("Fuel_Price", T.DoubleType()),
    T.StructField("MarkDown1", T.DoubleType()),
    T.StructField("MarkDown2", T.DoubleType()),
    T.StructField("MarkDown3", T.DoubleType()),
    T.StructField("MarkDown4", T.DoubleType()),
    T.StructField("MarkDown5", T.DoubleType()),
    T.StructField("CPI", T.DoubleType()),
    T.StructField("Unemployment", T.DoubleType()),
    T.StructField("IsHoliday", T.BooleanType()),
])

STORES = T.StructType([
    T.StructField("Store", T.IntegerType()),
    T.StructField("Type", T.StringType()),
    T.StructField("Size", T.LongType()),
])

DAILY_DEMAND = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("store", T.IntegerType()),
    T.StructField("item", T.IntegerType()),
    T.StructField("sales", T.LongType()),
])

SEARCH_DAILY = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("term", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RESULTS = T.StructType([
    T.StructField("Store", T.IntegerType()),
    T.StructField("Dept", T.IntegerType()),
    T.StructField("Store_Type", T.StringType()),
    T.StructField("Model", T.StringType()),
    T.StructField("MAE", T.DoubleType()),
    T.StructField("MAPE", T.DoubleType()),
    T.StructField("Avg_Sales", T.DoubleType()),
])

SCENARIO = T.StructType([
    T.StructField("Store", T.IntegerType()),
    T.StructField("Dept", T.IntegerType()),
    T.StructField("Temperature", T.DoubleType()),
    T.StructField("Fuel_Price", T.DoubleType()),
    T.StructField("CPI", T.DoubleType()),
    T.StructField("Unemployment", T.DoubleType()),
    T.StructField("IsHoliday", T.BooleanType()),
    T.StructField("Size", T.IntegerType()),
])
