"""Spans: overlap islands, rule and ensemble reduction, tags to spans and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import RULE

TOLERANCE = 3e-7


def islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``island``, from 1: spans that overlap, by chains of overlaps, share one; touching spans don't."""
    w = W.partitionBy(*by).orderBy("offset", F.desc("length"))
    reach = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("offset") >= reach), 1).otherwise(0)
    return spans.withColumn("_new", starts).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def overlapping_pairs(spans: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``overlaps``: whether the span reaches over the next one's start."""
    nxt = F.lead("offset").over(W.partitionBy(*by).orderBy("offset", F.desc("length")))
    return spans.withColumn("overlaps", F.coalesce(F.col("offset") + F.col("length") > nxt, F.lit(False)))


def union_average(spans: DataFrame, by: list[str]) -> DataFrame:
    """One span for each island: first label, mean probability, or-ed flags, from the first offset to the last end."""
    first = F.min(F.struct("offset", (-F.col("length")).alias("l"), "label"))
    g = islands(spans, by).groupBy(*by, "island").agg(first.alias("f"), F.avg("probability").alias("probability"), F.bit_or("flags").alias("flags"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return g.select(*by, F.col("f.label").alias("label"), "probability", "flags", F.col("f.offset").alias("offset"), (F.col("end") - F.col("f.offset")).alias("length"))


def _better(a: dict, b: dict) -> dict:
    """Of two spans the surer; then the longer; then the smaller label. A rule beats a model."""
    if (a["flags"] & RULE) != (b["flags"] & RULE):
        return a if a["flags"] & RULE else b
    x, y = abs(a["probability"] - 0.5), abs(b["probability"] - 0.5)
    if abs(x - y) > TOLERANCE:
        return a if x > y else b
    if a["length"] != b["length"]:
        return a if a["length"] > b["length"] else b
    return a if a["label"] <= b["label"] else b


def greedy(spans: list[dict]) -> list[dict]:
    """Spans in order of offset, longest first; each run of spans that begin inside its head leaves the best of it."""
    out: list[dict] = []
    rest = sorted(spans, key=lambda s: (s["offset"], -s["length"], s["label"]))
    while rest:
        best, end = rest[0], rest[0]["offset"] + rest[0]["length"]
        i = 1
        while i < len(rest) and rest[i]["offset"] < end:
            best = _better(best, rest[i])
            i += 1
        out.append(best)
        rest = [s for s in rest[i:] if s["offset"] >= best["offset"] + best["length"]]
    return out


def overlap(spans: list[dict]) -> bool:
    s = sorted(spans, key=lambda x: (x["offset"], -x["length"]))
    return any(a["offset"] + a["length"] > b["offset"] for a, b in zip(s, s[1:]))


def _union(spans: list[dict]) -> list[dict]:
    out: list[list[dict]] = []
    for s in sorted(spans, key=lambda x: (x["offset"], -x["length"])):
        if out and s["offset"] < max(x["offset"] + x["length"] for x in out[-1]):
            out[-1].append(s)
        else:
            out.append([s])
    merged = []
    for g in out:
        flags = 0
        for s in g:
            flags |= s["flags"]
        end = max(s["offset"] + s["length"] for s in g)
        merged.append(g[0] | {"probability": sum(s["probability"] for s in g) / len(g), "flags": flags, "length": end - g[0]["offset"]})
    return merged


def reduce_rule_spans(spans: list[dict]) -> list[dict]:
    """Without overlaps as they are; else positive and negative spans are merged apart, then chosen among greedily."""
    if not overlap(spans):
        return spans
    merged = _union([s for s in spans if s["probability"] >= 0.5]) + _union([s for s in spans if s["probability"] < 0.5])
    return greedy(merged) if overlap(merged) else merged


def reduce_ensemble(spans: list[dict]) -> list[dict]:
    """Greedy choice, rules before models, then without negative rule spans. Two models' spans may not overlap."""
    models = [s for s in spans if not s["flags"] & RULE]
    if overlap(models):
        raise ValueError("spans of models overlap")
    return [s for s in greedy(spans) if not (s["flags"] & RULE and s["probability"] < 0.5)]


_REDUCERS = {"greedy": greedy, "rules": reduce_rule_spans, "ensemble": reduce_ensemble}


#: Spans that are Python objects at once, in lists of whole documents.
FOLD_SPANS = 20_000


def _parts(v: pa.ListArray):
    """Slices of about ``FOLD_SPANS`` items, a longer list alone; an empty array is one slice."""
    reach = np.cumsum(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    begin, before = 0, 0
    while begin < len(v) or not begin:
        end = max(begin + 1, int(np.searchsorted(reach, before + FOLD_SPANS, "right")))
        yield v.slice(begin, end - begin)
        begin, before = end, int(reach[end - 1]) if len(v) else 0


def reduce_spans(spans: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """``greedy``, ``rules`` or ``ensemble`` on each document's ``(label, probability, flags, offset, length)``; an order-dependent fold, so Python, a batch of documents at a time."""
    fold = _REDUCERS[how]
    fields = ["label", "probability", "flags", "offset", "length"]
    kinds = dict(spans.dtypes)
    item = "array<struct<" + ", ".join(f"{n}: {kinds[n]}" for n in fields) + ">>"

    @F.arrow_udf(item)
    def run(v: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([fold(x) if len(x) > 1 or how == "ensemble" else x for x in part.to_pylist()], v.type) for part in _parts(v)])

    lists = spans.groupBy(id_col).agg(F.collect_list(F.struct(*fields)).alias("_s"))
    return lists.select(id_col, F.explode(run.asNondeterministic()("_s")).alias("s")).select(id_col, "s.*")


def assemble_bio(tags: DataFrame, by: list[str]) -> DataFrame:
    """Spans ``(by, label, start, end, n, probability)`` of rows ``(by, pos, tag, confidence, offset, length)``.

    A B tag begins a span that following I tags of its label go on with; I tags without one are skipped.
    """
    w = W.partitionBy(*by).orderBy("pos")
    kind, label = F.substring("tag", 1, 1), F.substring("tag", 2, 1_000_000)
    rows = tags.withColumn("_kind", kind).withColumn("_label", label)
    joins = (F.col("_kind") == "I") & F.lag("_kind").over(w).isin("B", "I") & (F.lag("_label").over(w) == F.col("_label"))
    rows = rows.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = rows.groupBy(*by, "_run").agg(F.min_by("_kind", "pos").alias("first"), F.first("_label").alias("label"), F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("n"), F.avg("confidence").alias("probability"))
    return g.where("first = 'B'").drop("_run", "first")


def tag_bio(tokens: DataFrame, annotations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, tag)``: the first token that overlaps an annotation is B, the next ones that begin before its end I, others O.

    ``tokens`` is ``(doc_id, pos, offset, length)``, ``annotations`` ``(doc_id, label, offset, length)``, disjoint inside a document.
    """
    a = annotations.select(F.col(id_col).alias("_id"), F.col("label").alias("_label"), F.col("offset").alias("_o"), (F.col("offset") + F.col("length")).alias("_e"))
    on = (F.col(id_col) == F.col("_id")) & (F.col("offset") + F.col("length") > F.col("_o")) & (F.col("offset") < F.col("_e"))
    first = F.row_number().over(W.partitionBy(id_col, "_o").orderBy("pos"))
    hits = tokens.join(a, on, "left").withColumn("_first", F.when(F.col("_o").isNotNull(), first))
    # a token over two annotations goes to the earlier one
    hits = hits.groupBy(id_col, "pos").agg(F.min(F.struct("_o", "_label", "_first")).alias("h"))
    tag = F.when(F.col("h._o").isNull(), "O").otherwise(F.concat(F.when(F.col("h._first") == 1, "B").otherwise("I"), F.col("h._label")))
    return hits.select(id_col, "pos", tag.alias("tag"))


def align_to_tokens(annotations: DataFrame, tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Gold spans at token boundaries: from the first overlapping token, as long as these tokens together."""
    t = tokens.select(F.col(id_col).alias("_id"), F.col("offset").alias("_o"), F.col("length").alias("_l"))
    on = (F.col(id_col) == F.col("_id")) & (F.col("_o") + F.col("_l") > F.col("offset")) & (F.col("_o") < F.col("offset") + F.col("length"))
    return annotations.join(t, on).groupBy(id_col, "label", "offset", "length").agg(F.min("_o").alias("start"), F.sum("_l").alias("size")).select(id_col, "label", F.col("start").alias("offset"), F.col("size").cast("int").alias("length"))


def contains_token(offset: Column, length: Column, token_offset: Column, token_length: Column) -> Column:
    """Whether an annotation covers part of a token; one without offset covers all."""
    return offset.isNull() | length.isNull() | ((token_offset + token_length > offset) & (token_offset < offset + length))
