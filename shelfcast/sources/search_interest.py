"""Landed daily search-interest files, long form (date, term, value), to one row per day."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.sources.readers import read_csv


def read_search_daily(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All landed periods in one scan; overlapping periods keep the larger value of a day and term."""
    landed = read_csv(spark, path, schemas.SEARCH_DAILY)
    return landed.groupBy("date", "term").agg(F.max("value").alias("value"))


def pivot_terms(daily: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One column per term; a day missing for a term is NULL, as after a chain of outer joins."""
    return daily.groupBy("date").pivot("term", list(terms)).agg(F.first("value", ignorenulls=True))


def outer_join_terms(daily: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The literal chain of full outer joins on date. Same result as ``pivot_terms``, one shuffle per term."""
    parts = [daily.where(F.col("term") == t).select("date", F.col("value").alias(t)) for t in terms]
    return reduce(lambda left, right: left.join(right, "date", "full"), parts)
