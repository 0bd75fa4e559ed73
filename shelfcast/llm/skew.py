"""Joins that look up one row per key for many rows, where a few keys may hold most of the rows.

A key is hot if it holds more than one in ``HOT_PARTS`` of all rows, so there are fewer than ``HOT_PARTS`` hot keys
whatever the size of the input: they are broadcast, and their rows stay where they are. All other keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1_000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], counted: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined ("left" or "inner") with ``table``, which has one row for each of its keys.

    ``counted`` is a column of ``table`` with the number of rows that hold the key, ``total`` the number of all rows; the
    column goes no further. Keys must not be NULL.
    """
    is_hot = F.col(counted) * F.lit(HOT_PARTS) > F.lit(total)
    hot, rest = table.filter(is_hot).drop(counted), table.filter(~is_hot).drop(counted)
    at_hot = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return at_hot.unionByName(others.join(rest, keys, how))
