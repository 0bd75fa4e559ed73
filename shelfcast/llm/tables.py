"""Intermediate tables in the shared folder, and sizes that follow the data."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import ensure_checkpoint_dir

_MADE: list[str] = []


#: Stands for a NULL id inside operators that keep ids as numbers; it comes before all others.
NO_ID = -(1 << 63)


def numbered(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def given(number: str) -> Column:
    return F.when(F.col(number) != NO_ID, F.col(number))


def fresh(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: Bytes of rows that go to a Python task at once, about; a longer row goes alone.
BATCH_BYTES = "8m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in small batches while this holds, so that tasks hold little beside their slices."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written_at(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet below ``spark.checkpoint.dir``, read again, and its path.

    Computed once, and safe from lost executors: what follows reads the files, not the lineage.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession)
    with small_batches(spark):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, **options: str) -> DataFrame:
    return written_at(df, **options)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written_at`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def result_of(make: Callable[[], DataFrame]) -> DataFrame:
    """The small result of ``make``, written; the intermediate tables made on the way are deleted."""
    before = set(_MADE)
    out, path = written_at(make())
    for other in [p for p in _MADE if p not in before and p != path]:
        delete(out.sparkSession, other)
    return out


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this process; results that still read them become invalid."""
    for path in list(_MADE):
        delete(spark, path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def buckets_for(total: int, each: int) -> int:
    """So many buckets that each holds about ``each`` bytes, however large the input is."""
    return max(8, math.ceil(total / each))


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")
