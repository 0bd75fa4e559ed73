import pytest
from pyspark.sql import functions as F

from llm.llm_cases import ODD

@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, with extra columns whose names clash with the operators' own."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = {c: F.lit(7) for c in ("_id", "_text", "_key", "size", "n", "label", "hash", "doc", "key", "kind", "bucket", "set", "group", "node", "finish", "round")}
    return rows.withColumns({"source": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)), "lang": F.lit(None).cast("string")} | extra)


@pytest.fixture(scope="session")
def texts(data_dir):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{data_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]
