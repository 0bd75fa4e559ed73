"""Raw CSV tables to the written fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators.features import build_fact, weekly_trends
from shelfcast.sources.readers import load_raw, read_optional, read_parquet
from shelfcast.sources.search_interest import pivot_terms, read_search_daily
from shelfcast.sources.sinks import write_table


def prepare_fact(
    spark: SparkSession,
    raw: str,
    out: str,
    search: str | Sequence[str] | None = None,
    terms: Sequence[str] = (),
    date_format: str | None = None,
) -> DataFrame:
    """Join, clean and enrich the raw tables in one plan, write it once, return the written table.

    Search interest is optional: without landed files the fact has no trend columns.
    """
    tables = load_raw(spark, raw, date_format)
    daily = read_optional(read_search_daily, spark, search) if search else None
    trends = weekly_trends(pivot_terms(daily, terms), terms) if daily is not None else None
    fact = build_fact(tables["sales"], tables["features"], tables["stores"], trends)
    write_table(fact, f"{out.rstrip('/')}/fact")
    return read_parquet(spark, f"{out.rstrip('/')}/fact")
