"""Training-corpus pipeline: each stage works on the Parquet that the one before it wrote.

Defined results, of every stage but the last: all columns of its input come out, whatever their names, in their order; rows with
null or empty texts stay, but for those that the quality classifier rejects; texts are worked on whole whatever their length; rows that repeat
are treated alike, except that near-dedup keeps one of them; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, mixing, quality, secrets, simhash
from textloom.llm.common import forget, materialize, table, written
from textloom.session import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled rows among them, rejects go; without labels of both classes all stay.

    Ties at the threshold stay; a null or empty text scores the model's bias.
    """
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id, nulls last, of equal ids the smallest text hash. Texts without words are in no group."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts, until none is left; documents of which nothing is left go, others follow in ``n_chars``."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret literals are replaced in the texts; every document stays, ``n_chars`` follows the text."""
    ship(spark)
    return secrets.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training order: the documents at their positions, by the sources' weight schedules, as often as their source's demand asks.

    Columns named ``epoch``, ``n_tokens`` or ``position`` come out with an underscore before their name. Texts without a word, and documents beyond
    their source's demand, have no position.
    """
    ship(spark)
    return mixing.mix(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "source")))


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminated), ("secret_scan", without_secrets), ("mixing", mixed)]
#: SimHash and the classifier have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(ship(spark), sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        forget(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
