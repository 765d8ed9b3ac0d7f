"""Readers and writers of the engine's own artefacts: versioned JSON, JSON lines and norms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.schema import REVIEW_LOG, SCHEMA_VERSION


def write_artefact(rows: DataFrame, path: str) -> None:
    rows.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(path)


def read_artefact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of this schema version; a row of another version fails the read."""
    rows = spark.read.schema(f"{schema}, schema_version int").json(path)
    checked = F.when(F.col("schema_version") == SCHEMA_VERSION, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing")))).cast("int"))
    return rows.withColumn("schema_version", checked).filter(F.col("schema_version").isNotNull()).drop("schema_version")


def read_review_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log; lines that do not parse are skipped."""
    return spark.read.schema(REVIEW_LOG).option("mode", "DROPMALFORMED").json(path).filter("card_id IS NOT NULL AND at IS NOT NULL")


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    """(word, mean) of a concreteness norms file with the columns ``Word`` and ``Conc.M``; tab or comma."""
    head = spark.read.text(path).first()
    separator = "\t" if head and "\t" in head[0] else ","
    rows = spark.read.option("header", True).option("sep", separator).csv(path)
    return rows.select(F.lower(F.trim("Word")).alias("word"), F.col("`Conc.M`").cast("double").alias("mean")).filter("word <> '' AND mean IS NOT NULL")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Every ``programme.json`` under ``path``, newest first; unreadable ones are skipped."""
    schema = "programme_id string, title string, created_at timestamp, minutes double, cards long"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "programme.json").json(path)
    return rows.filter("programme_id IS NOT NULL").orderBy(F.desc("created_at"), "programme_id")
