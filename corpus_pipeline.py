"""The corpus pipeline: five filters and transforms over ``documents``, each an operator of its own.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  ``run``
writes each stage's result as Parquet into the shared folder and reads it back as the next one's
input.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import bpe, decontam, langid, ngram_join, toxicity
from studyloom.llm.common import materialize, table
from studyloom.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is rejected when it is undetermined or less likely than this.
LEAST_LANGUAGE_SCORE = 0.4
#: Ids up to this count are broadcast when their documents are left out; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for every row in ``row``; ids may be null or repeated.  Written down, so that it stays the same."""
    return materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without those whose row is in ``rows`` (a materialized table)."""
    few = rows.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rows) if few else rows, "row", "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language; texts without letters (null ones too) and uncertain ones go."""
    found = langid.predict_languages(docs, langid.fit(docs), keep=[*COLUMNS[1:]])
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that score under one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, keep=[*COLUMNS[1:]]).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, with the smallest id; texts without words and rows with a null id are no one's duplicates."""
    docs = keyed(docs)
    classes = materialize(ngram_join.near_duplicates(docs.filter("doc_id IS NOT NULL"), id_col="row").select("row", "component_id"))
    first = classes.join(docs.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    others = materialize(classes.join(first.select("first.row"), "row", "left_anti").select("row"))
    return without(docs, others).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that hold no benchmark item, as it is or re-parameterised."""
    docs = keyed(docs)
    items = materialize(table(spark, sf_dir, "benchmark").select("text").withColumn("item_id", F.monotonically_increasing_id()))
    found = decontam.matches(docs, items, id_col="row")
    return without(docs, materialize(found.select("row").distinct())).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the decoded text."""
    encoded = bpe.encode_texts(docs, VOCABULARY)
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Learned models and BPE merges are beyond SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
