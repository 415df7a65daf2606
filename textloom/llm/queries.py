"""The corpus operators as queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, mixing, pii, quality, recompress, rules, secrets, simhash, token_counts
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), runs=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in groups of two or more, each with the smallest id of its group."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.withColumn("position", F.round("position", 6))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where(F.col("score") >= quality.THRESHOLD)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeated_spans(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that keep to all rules, with their measures."""
    return rules.measured(table(spark, sf_dir, "documents")).where("keep").drop("keep")


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_secrets, op3_licenses, op4_simhash, op5_mixing, op6_quality, op7_decontamination, op8_pii, op9_substrings, op10_rules)
}
ORACLES = {"op3_licenses": licenses.oracle(), "op5_mixing": mixing.oracle(), "op10_rules": rules.oracle()}
