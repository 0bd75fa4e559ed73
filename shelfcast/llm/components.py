"""Connected components of an edge table, by min-label propagation with shortcuts.

Every round gives a node the least label of itself and its neighbours, then the label of its label. Labels are aggregated
in each task before the shuffle, joins on a hot node are left to the adaptive skew join, and each round is written to the
shared folder, so a lost executor costs one round at most. Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import tables

#: Rows of a written file, about: small graphs are written by few tasks, large ones by as many as they need.
FILE_ROWS = 100_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the least node it is connected with) of every node on an edge. Loops and repeats do no harm."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    both, edge_path = tables.written_at(pairs.union(pairs.select(F.col("dst"), F.col("src"))).distinct())
    files = max(8, both.count() // FILE_ROWS)
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("label")).withColumn("old", F.col("node"))
    labels, path = tables.written_at(labels.coalesce(files))
    while labels.filter("label != old").limit(1).count():
        own = labels.select("node", "label", F.col("label").alias("old"))
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label", F.lit(None).alias("old"))
        best = own.union(near).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        # A label is a node too: take over its label where that is smaller.
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        best = best.join(to, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        new, new_path = tables.written_at(best.coalesce(files))
        tables.delete(spark, path)
        labels, path = new, new_path
    tables.delete(spark, edge_path)
    return labels.select("node", F.col("label").alias("component"))
