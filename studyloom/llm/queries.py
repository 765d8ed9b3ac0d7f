"""Registered queries of the training-data operators, with their DuckDB oracles where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from studyloom.llm import bpe, decontam, embed_dedup, html_extract, langid, license_scan, ngram_join, token_counts, toxicity, warc
from studyloom.llm.common import table

#: Vocabulary file of the byte-level BPE queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), VOCABULARY, ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_bpe": op5_bpe,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_html_extract": op7_html_extract,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op4_warc_revisits": warc.oracle(),
    "op6_ngram_jaccard_join": ngram_join.oracle(),
    "op10_embedding_dedup": embed_dedup.oracle(),
}
