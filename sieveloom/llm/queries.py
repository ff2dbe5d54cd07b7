"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from sieveloom.llm import bpe, decontam, embdup, licenses, neardup, quality, substring, toxicity, urls, warc


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    return decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark, sf_dir):
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_quality(spark, sf_dir):
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_neardup(spark, sf_dir):
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), k=2)


def op6_substring(spark, sf_dir):
    return substring.removed(_read(spark, sf_dir, "documents"))


def op5_licenses(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.derived(warc.responses(_read(spark, sf_dir, "pages")))


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_urls(spark, sf_dir):
    return urls.judge(_read(spark, sf_dir, "pages"))


def op10_embdup(spark, sf_dir):
    return embdup.near_duplicates(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_toxicity, op3_quality, op4_neardup, op5_licenses, op6_substring, op7_urls, op8_warc, op9_bpe, op10_embdup)
}
ORACLE = {"op8_warc": warc.oracle_sql()}
