"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir); all but the last return the columns they were given, whatever these are. NULL and
empty texts fail the quality rules and so leave at the first stage. Rows that repeat an id, or have none, share their fate. An empty
table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import mixing, phrase_index, quality_trees, signature_join, token_output
from shelfcast.llm.queries import tokenizer_path
from shelfcast.llm.tables import fresh, read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go; the trees are fitted on the labelled documents."""
    return quality_trees.kept_documents(docs, quality_trees.fit(docs, read(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays."""
    classes = signature_join.similar_classes(docs)
    stay = classes.filter("doc_id <=> component_id").select(F.col("doc_id").alias("_stays")).distinct()
    # The list of ids grows with the documents, so it is shuffled at every size, and only the list is held in memory.
    return docs.join(stay.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_stays")), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    found = phrase_index.matches(docs, read(spark, sf_dir, "benchmark"))
    leaks = found.filter("size(spans) > 0").select(F.col("doc_id").alias("_leaks")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leaks")), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as files of coded token ids; what reading them back gives per document."""
    path = fresh(spark)
    token_output.write_ids(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return token_output.read_ids(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: The verdict of the first stage is a fitted model's, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
