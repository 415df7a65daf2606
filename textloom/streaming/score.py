"""Fitted models on streams: scoring is stateless, so the batch plan runs on micro-batches unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules


def score_rules(docs: DataFrame, rule_list: list[tuple[str, str, float]]) -> DataFrame:
    """``(doc_id, label, rule, weight, n)`` for a streaming or batch DataFrame."""
    return rules.document_rule_matches(docs, rule_list)


def score_linear(docs: DataFrame, words: str, weights: dict[str, float], intercept: float) -> DataFrame:
    """``(doc_id, probability)`` of an array column of words by a small weight table, without an aggregation and so without state."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    margin = F.aggregate(words, F.lit(float(intercept)), lambda acc, w: acc + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return docs.select("doc_id", (1 / (1 + F.exp(-margin))).alias("probability"))


def land(stream: DataFrame, path: str, log: str) -> None:
    """Take all of a stream there is, batch by batch, to Parquet; a restart from the same log goes on where it stopped, once a row."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", log).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
