"""Results kept on disk under a key of what they were made from: the files that were read, and the parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources import sinks


def content_key(spark: SparkSession, paths: Sequence[str], parameters: object = ()) -> str:
    """A key that changes when a file below ``paths`` comes, goes, or changes its size or time, or when a parameter changes.

    Spark lists the files and merges their hashes; none is opened. A path that does not exist has a key of its own.
    """
    digest = hashlib.sha256(repr(parameters).encode())
    for path in paths:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            one = F.xxhash64("path", "length", "modificationTime")
            other = F.xxhash64(F.lit(1), "modificationTime", "length", "path")
            row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(one), F.bit_xor(other)).first()
            found = tuple(row)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            found = ("absent",)
        digest.update(repr((path, found)).encode())
    return digest.hexdigest()[:40]


def remembered(spark: SparkSession, folder: str, name: str, inputs: Sequence[str], make: Callable[[], DataFrame], parameters: object = ()) -> DataFrame:
    """The table ``make`` gives for these inputs and parameters, read from ``folder`` if it was written there before.

    Other sessions share what is written. An entry counts once its write has ended, so a job that died leaves none; when inputs
    change there is a new entry beside the old one, which jobs may still be reading.
    """
    path = f"{folder.rstrip('/')}/{name}-{content_key(spark, inputs, parameters)}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        sinks.write_table(make(), path)
    return spark.read.parquet(path)
