"""The corpus pipeline: five stages on documents, each written as Parquet and reread by the next.

All stages but the last return the columns of documents; each works on all that the one before kept.
SQL cannot express them (a fitted classifier, exact similarity joins, byte-pair merges), so ORACLE_SQL is
None and tests/llm compare the stages with brute force.

Defined cases, beside those of the operators: of rows with one doc_id one stays after the second stage, and rows
without a doc_id all do; null and empty texts are linked with nothing and stay where the classifier keeps them; without both labels the classifier keeps all; other columns stay until the last stage, whatever
their names; very long texts are taken whole; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.llm import bpe, decontamination, jaccard, pii, site_quality
from postlark.llm._text import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-quality score accepts."""
    return site_quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id, and of its rows one."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
