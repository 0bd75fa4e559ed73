"""Derive the retail tables from the order-warehouse Parquet tables (lineitem, orders, ...).

The mapping is deterministic. Money is summed in whole units, so a total does not depend on the
order in which partitions are merged. Small sides are left to the size-checked broadcast
choice of the optimizer: part, supplier and customer grow with the data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.calendar import iso_week, week_monday
from shelfcast.functions.scalars import exact_total, hundredths

# Fixed values of the mapping.
PRODUCT_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TERMS = ("urgent", "high", "medium", "not_specified", "low")
HOLIDAY_WEEKS = (6, 36, 47, 52)
TRAIN_END = "2000-01-01"
VAL_END = "2001-01-01"


def is_holiday_week(date: Column | str) -> Column:
    return iso_week(date).isin(*HOLIDAY_WEEKS)


def _dept(product_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in PRODUCT_TYPES]), product_type).cast("int")


def _net_price() -> Column:
    """Discounted price of a line in 1/10,000."""
    return hundredths("l_extendedprice") * (F.lit(100) - hundredths("l_discount"))


def first_monday(day: str, after: bool = False) -> dt.date:
    """The first Monday on ``day`` or later; with ``after`` the first one later than ``day``."""
    start = dt.date.fromisoformat(day) + dt.timedelta(days=int(after))
    return start + dt.timedelta(days=-start.weekday() % 7)


@dataclass(frozen=True)
class Warehouse:
    """Lazy access to the retail tables of one data folder."""

    spark: SparkSession
    base: str

    def path(self, name: str) -> str:
        return f"{self.base}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _lines(self, amount: Column, date_from: str | None, date_to: str | None, depts: Sequence[int] | None) -> DataFrame:
        """Lines with their week, store and department. Bounds on weeks and departments become bounds on the stored
        columns, so that Parquet row groups outside them are not read."""
        lines, part = self.table("lineitem"), self.table("part")
        shipped = lambda day: F.lit(day.isoformat()).cast(lines.schema["l_shipdate"].dataType)
        if date_from:
            lines = lines.where(F.col("l_shipdate") >= shipped(first_monday(date_from)))
        if date_to:
            lines = lines.where(F.col("l_shipdate") < shipped(first_monday(date_to, after=True)))
        if depts:
            part = part.where(F.col("p_type").isin([PRODUCT_TYPES[d - 1] for d in depts if 1 <= d <= len(PRODUCT_TYPES)]))
        lines = lines.select("l_partkey", "l_suppkey", week_monday(F.col("l_shipdate").cast("date")).alias("Date"), amount.alias("_amount"))
        part = part.select("p_partkey", _dept(F.col("p_type")).alias("Dept"))
        supplier = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("Store"))
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
            supplier, F.col("l_suppkey") == F.col("s_suppkey")
        )

    def _weekly(
        self, amount: Column, date_from: str | None = None, date_to: str | None = None, depts: Sequence[int] | None = None
    ) -> DataFrame:
        # Known keys are demanded here, at the scans: joins on them then add no filter of their own, and
        # every use of the table in a query shares one shuffle.
        return (
            self._lines(amount, date_from, date_to, depts)
            .where("Store is not null and Dept is not null and Date is not null")
            .groupBy("Store", "Dept", "Date")
            .agg(exact_total("_amount", 4).alias("Weekly_Sales"))
            .withColumn("IsHoliday", is_holiday_week("Date"))
        )

    def sales(self, date_from: str | None = None, date_to: str | None = None, depts: Sequence[int] | None = None) -> DataFrame:
        """Weekly sales per (Store, Dept, Date); the grain bounds every series by its number of weeks.

        The optional bounds keep whole weeks (Date from ``date_from`` to ``date_to``) and departments, at the scan.
        """
        return self._weekly(_net_price(), date_from, date_to, depts)

    def sales_net(self) -> DataFrame:
        """The same with returned lines counted negative, so some weeks are below zero."""
        sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
        return self._weekly(_net_price() * sign)

    def features(self) -> DataFrame:
        orders = self.table("orders").select(
            "o_custkey",
            "o_orderpriority",
            "o_orderstatus",
            week_monday(F.col("o_orderdate").cast("date")).alias("Date"),
            hundredths("o_totalprice").alias("_price"),
        )
        customer = self.table("customer").select(
            "c_custkey", F.col("c_nationkey").alias("Store"), hundredths("c_acctbal").alias("_balance")
        )
        per_thousand = lambda c: exact_total(c, 2) / F.count(F.lit(1)) / 1000
        markdowns = [
            exact_total(F.when(F.col("o_orderpriority") == p, F.col("_price")), 2).alias(f"MarkDown{i}")
            for i, p in enumerate(PRIORITIES, start=1)
        ]
        return (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .where("Store is not null and Date is not null")
            .groupBy("Store", "Date")
            .agg(
                per_thousand("_price").alias("Temperature"),
                per_thousand("_balance").alias("Fuel_Price"),
                *markdowns,
                F.count(F.lit(1)).cast("double").alias("CPI"),
                (F.count_if(F.col("o_orderstatus") == "F") * 100 / F.count(F.lit(1))).alias("Unemployment"),
            )
            .withColumn("IsHoliday", is_holiday_week("Date"))
        )

    def stores(self) -> DataFrame:
        suppliers = self.table("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("_n"))
        kind = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("n_regionkey") % 3 + 1).cast("int"))
        return (
            self.table("nation")
            .join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
            .select(
                F.col("n_nationkey").alias("Store"),
                kind.alias("Type"),
                (F.coalesce("_n", F.lit(0)) * 1000).cast("bigint").alias("Size"),
            )
            .where("Store is not null")
        )

    def search_daily(self) -> DataFrame:
        """Daily order counts per priority stand for daily interest per search term."""
        term = F.element_at(
            F.array(*[F.lit(t) for t in TERMS]),
            F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")).cast("int"),
        )
        return (
            self.table("orders")
            .select(F.col("o_orderdate").cast("date").alias("date"), term.alias("term"))
            .groupBy("date", "term")
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
        )

    def daily_demand(self) -> DataFrame:
        supplier = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("store"))
        return (
            self.table("lineitem")
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                F.col("l_shipdate").cast("date").alias("date"),
                "store",
                (F.col("l_partkey") % 50).cast("int").alias("item"),
            )
            .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sales"))
        )
