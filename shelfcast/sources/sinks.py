"""Sinks. Group keys are ordinary columns, so nothing like a row index is ever written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, the hand-off format between stages."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV parts, each with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Export for download: a folder of parts, or one file if the caller asks for it (then one task writes all rows)."""
    write_csv(df.coalesce(1) if single_file else df, path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
