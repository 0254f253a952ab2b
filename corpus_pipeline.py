"""A training-data pipeline over the documents table: five stages, each of which calls one operator of detlake.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.llm import bpe, decontaminate, minhash, secrets, toxicity
from detlake.llm.frames import small_batches, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity classifier doesn't reject.

    Each row is judged by its own text, whatever its doc_id (null and
    repeated ones alike); null and empty texts stay unless most labels are
    toxic.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    All rows of a dropped doc_id go; rows with a null doc_id stay, since no
    id tells them apart.  Null and empty texts are nobody's duplicates.
    """
    bad = minhash.near_duplicates(docs, percent=80, shingle=5).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_id"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a benchmark item in them; each row is judged by its own text, null and empty ones stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with the secrets in their texts replaced; null texts stay null, repeated rows stay."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with counts and hashes; none for null and empty texts."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("secrets", redacted), ("encoding", encoded)]

#: No SQL: the classifier, the edit-distance search and the encoder are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
