"""Vocabularies, term counts, inverse document frequencies and vectors in long form ``(doc_id, dim, value)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import MOST_RANGES, RANGE_ROWS, row_numbers, running_sum

#: A vocabulary is broadcast only up to so many features; beyond, the join shuffles.
BROADCAST_FEATURES = 500_000


def features(docs: DataFrame, array: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, feature)`` of an array column."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(array).alias("pos", "feature")).where("feature is not null")


def gram_rows(docs: DataFrame, array: str, picks: list[list[int]], keep: tuple[str, ...] = (), by: str = " ") -> DataFrame:
    """``(keep, pick, gram)``: for each place of an array and each pick (offsets from it, the last one the largest) the items there, joined.

    The place is what is exploded, and the items are looked up, so neither arrays of arrays are made nor the array copied a row.
    """
    at = F.col("_at")
    places = docs.where(F.size(array) > 0).select(*keep, F.col(array).alias("_w"), F.explode(F.sequence(F.lit(1), F.size(array))).alias("_at"))
    grams = [F.when(at + p[-1] <= F.size("_w"), F.concat_ws(by, *[F.element_at("_w", at + k) for k in p])) for p in picks]
    return places.select(*keep, F.posexplode(F.array(*grams)).alias("pick", "gram")).where("gram is not null")


def build_vocabulary(feats: DataFrame, minimum: int = 0) -> DataFrame:
    """``(dim, feature, n_obs)``: a feature gets the next id at its ``minimum``-th occurrence (0 and 1: the first) by (doc_id, pos).

    Spark keeps the first ``minimum`` rows a feature before it shuffles (window group limit), so frequent features
    don't meet in one task; ids are numbered over distinct features only.
    """
    nth = max(minimum, 1)
    totals = feats.groupBy("feature").agg(F.count("*").alias("n_obs"))
    if nth == 1:
        seen = feats.groupBy("feature").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count("*").alias("n_obs"))
    else:
        k = F.row_number().over(W.partitionBy("feature").orderBy("doc_id", "pos"))
        reached = feats.withColumn("k", k).where(F.col("k") == nth).select("feature", F.struct("doc_id", "pos").alias("at"))
        seen = reached.join(totals, "feature")
    rows = seen.select("feature", "n_obs", F.col("at.doc_id").alias("doc_id"), F.col("at.pos").alias("pos"))
    return row_numbers(rows, "doc_id", ["pos"], "row").select((F.col("row") - 1).cast("int").alias("dim"), "feature", "n_obs")


def _maybe_broadcast(table: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(table) if rows is not None and rows <= BROADCAST_FEATURES else table


def term_counts(feats: DataFrame, vocabulary: DataFrame, size: int | None = None) -> DataFrame:
    """``(doc_id, dim, tf)``; features out of the vocabulary drop out. ``size``: the vocabulary's, if known, for the choice of join.

    ``feats``: rows of ``features``, or of ``array_counts``, which are counted already.
    """
    counted = feats if "tf" in feats.columns else feats.groupBy("doc_id", "feature").agg(F.count("*").alias("tf"))
    return counted.join(_maybe_broadcast(vocabulary.select("dim", "feature"), size), "feature").select("doc_id", "dim", "tf")


#: Tokens that are counted at once.
COUNT_TOKENS = 1_000_000


def array_counts(docs: DataFrame, array: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, feature, tf)`` of an array column, its nulls left out: counted in the row, so that one shuffle, by feature, is all there is.

    What then groups by feature, or joins on it, finds its rows together.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(array).alias("_w"))
    kind = dict(rows.dtypes)["doc_id"]

    def count(batches):
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("_w")
            reach, begin = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while begin < len(lists):
                end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + COUNT_TOKENS, "right")))
                some = lists.slice(begin, end - begin)
                words = some.flatten().dictionary_encode()
                code = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(begin, end), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                size = max(len(words.dictionary), 1)
                found, n = np.unique((row * size + code)[code >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found // size)), words.dictionary.take(pa.array(found % size)), pa.array(n.astype(np.int64))], ["doc_id", "feature", "tf"])
                begin = end

    counted = rows.mapInArrow(count, f"doc_id {kind}, feature string, tf long").repartition("feature")
    return counted.groupBy("feature", "doc_id").agg(F.sum("tf").alias("tf")).select("doc_id", "feature", "tf")


def chain_term_counts(feats: DataFrame, vocabulary: DataFrame, size: int | None = None) -> DataFrame:
    """``(doc_id, pos, dim, tf)`` of exploded links."""
    # shuffled once: rows of a feature meet for the join, and so do those of a link
    counted = feats.repartition("feature").groupBy("doc_id", "pos", "feature").agg(F.count("*").alias("tf"))
    return counted.join(_maybe_broadcast(vocabulary.select("dim", "feature"), size), "feature").select("doc_id", "pos", "dim", "tf")


def invert(vectors: DataFrame, vocabulary: DataFrame, offset: int = 0) -> DataFrame:
    """Adds ``feature`` to rows with a global ``dim``; null where the vocabulary lacks it."""
    return vectors.join(vocabulary.select((F.col("dim") + offset).alias("dim"), "feature"), "dim", "left")


def prune(vocabulary: DataFrame, used: DataFrame) -> DataFrame:
    """The vocabulary's rows whose ``dim`` is used; ids stay as they are."""
    return vocabulary.join(used.select("dim").distinct(), "dim", "left_semi")


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``(dim, df)`` from ``(doc_id, dim, tf)``."""
    return counts.groupBy("dim").agg(F.count("*").alias("df"))


def idf(frequencies: DataFrame, n_docs: DataFrame, min_docs: int = 0) -> DataFrame:
    """``(dim, df, idf)`` with ``idf = ln N - ln df``; dims under ``min_docs`` documents are left out. ``n_docs``: one row, column ``n``."""
    kept = frequencies.where(F.col("df") >= max(min_docs, 1))
    return kept.crossJoin(F.broadcast(n_docs)).select("dim", "df", (F.log("n") - F.log("df")).alias("idf"))  # one row


def tfidf(counts: DataFrame, table: DataFrame) -> DataFrame:
    """``(doc_id, dim, value)`` with ``tf * idf``, 0 for dims without idf."""
    return counts.join(table.select("dim", "idf"), "dim", "left").select("doc_id", "dim", (F.col("tf") * F.coalesce("idf", F.lit(0.0))).alias("value"))


def tfidf_running(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, dim, value)`` with the idf known when the document comes by: N and df up to and with it."""
    numbered = row_numbers(docs.select("doc_id").distinct(), "doc_id", [], "n")
    # a dim has a row a document at most: ranges are as many as the documents ask for, not as all dims' rows together
    seen = running_sum(counts, F.lit(1), "doc_id", [], ["dim"], "df", buckets=max(1, min(MOST_RANGES, docs.count() // RANGE_ROWS)))
    return seen.join(numbered, "doc_id").select("doc_id", "dim", (F.col("tf") * (F.log("n") - F.log("df"))).alias("value"))


def embedding_sums(feats: DataFrame, embeddings: DataFrame, by: list[str]) -> DataFrame:
    """``(by, i, value)``: component sums of the known words' vectors; ``embeddings`` is ``(feature, embedding)``."""
    joined = feats.join(embeddings, "feature").select(*by, F.posexplode("embedding").alias("i", "x"))
    return joined.groupBy(*by, "i").agg(F.sum(F.col("x").cast("double")).alias("value"))


def concatenate(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Vectors ``(doc_id, dim, value)`` side by side: each part's dims move by the sizes before it."""
    out, offset = None, 0
    for part, size in parts:
        moved = part.select("doc_id", (F.col("dim") + offset).alias("dim"), "value")
        out = moved if out is None else out.unionByName(moved)
        offset += size
    return out
