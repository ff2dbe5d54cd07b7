"""A training corpus from `documents`: quality classifier, near-dedup, substring dedup,
decontamination, tokens. Each stage takes (spark, docs, sf_dir) and works on all rows its
predecessor kept; run() writes each stage as Parquet in the shared folder and reads it again.
All but the last return the columns of documents.

Edge cases are those of the operators: null and empty texts are scored like any text, are
linked with nothing, lose nothing and have no tokens; an empty table passes through as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.llm import bpe, common, decontam, neardup, quality, substring


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8."""
    return neardup.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of twenty words that also stand earlier are taken out."""
    return substring.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, give or take its error budget, go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and whether decoding gives the text back."""
    import public_tokenizers

    coded = bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("quality classifier", quality_classifier), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontamination), ("tokens", tokens)]
#: The stages are models, components and hashes of windows: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
