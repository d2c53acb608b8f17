"""A corpus cleaning pipeline over documents: each stage works on all its predecessor kept.

The stages drop documents that the quality classifier rejects, keep one document of each group of
near duplicates (the lowest doc_id), drop documents with a benchmark passage, redact personal data,
and encode what remains.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontam, neardup, pii, quality
from quern.llm.tables import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_redaction", pii_stage),
    ("bpe_encoding", bpe_stage),
]

#: Latent-semantic scores, register bands and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; between stages the rows are Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/quern/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
