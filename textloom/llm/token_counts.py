"""Exact token-length histogram and what suffix sums over it answer.

Whole texts are encoded by a public byte-level BPE vocabulary (a path, read on the driver and broadcast, so
executors need no file). Documents are aggregated by encoded length on the map side; the shuffle carries one row
a distinct length, and the suffix sums run over those rows only, whose number is bounded by the longest text.

Defined results: a null or empty text has 0 tokens and counts as a document. An empty table gives no rows, and limits and quantiles of it
nothing that fits. Repeated rows count as often as they occur. Texts are encoded whole whatever their length.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split of a text into pieces, none of which a token crosses (the public GPT-2 rule).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is encoded in parts of about so many characters, cut where the split cuts anyway, so memory stays bounded.
PART_CHARS = 1_000_000
_ENCODERS: dict[int, object] = {}


def _encoder(raw: bytes):
    key = hash(raw)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def count_tokens(text: str | None, encoder) -> int:
    """Cuts fall between a letter or digit and a following single space before a letter: always a piece boundary."""
    if not text:
        return 0
    n, at = 0, 0
    while len(text) - at > PART_CHARS:
        cut = at + PART_CHARS
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        n += len(encoder.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(encoder.encode_ordinary(text[at:]))


def token_count(df: DataFrame, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Encoded length of a text as an Arrow UDF."""
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def tokens(v: pa.Array) -> pa.Array:
        encoder = _encoder(raw.value)
        return pa.array([count_tokens(t, encoder) for t in v.to_pylist()], pa.int64())

    return tokens.asNondeterministic()(text)


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each distinct length ``n_tokens``: documents and tokens of that length, of at least and of at most it;
    ``truncated_tokens``, the corpus total if each text is cut to ``n_tokens``; ``cdf``, the share of documents up to it."""
    lengths = docs.select(token_count(docs, col(text_col), vocabulary).alias("n_tokens"))
    hist = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    up = W.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tokens = F.col("n_docs") * F.col("n_tokens")
    out = hist.select(
        "n_tokens", "n_docs", tokens.alias("tokens"),
        F.sum("n_docs").over(down).alias("docs_at_least"), F.sum(tokens).over(down).alias("tokens_at_least"),
        F.sum("n_docs").over(up).alias("docs_at_most"), F.sum(tokens).over(up).alias("tokens_at_most"),
    )
    cut = F.col("tokens_at_most") + F.col("n_tokens") * (F.col("docs_at_least") - F.col("n_docs"))
    return out.withColumn("truncated_tokens", cut).withColumn("cdf", F.col("docs_at_most") / (F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: documents that fit, tokens kept and lost by truncation. Looked up in the running sums, in one ordered pass over limits and lengths."""
    wanted = histogram.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    sums = histogram.select(F.col("n_tokens").alias("x"), F.lit(0).alias("asked"), "docs_at_most", "tokens_at_most")
    none = F.lit(None).cast("long")
    both = sums.unionByName(wanted.select(F.col("context_limit").alias("x"), F.lit(1).alias("asked"), none.alias("docs_at_most"), none.alias("tokens_at_most")))
    up = W.orderBy("x", "asked").rowsBetween(W.unboundedPreceding, 0)
    last = lambda c, w: F.coalesce(F.max(c).over(w), F.lit(0))
    rows = both.select("x", "asked", last("docs_at_most", up).alias("docs"), last("tokens_at_most", up).alias("tokens"), last("docs_at_most", W.partitionBy()).alias("all_docs"), last("tokens_at_most", W.partitionBy()).alias("all_tokens"))
    kept = F.col("tokens") + F.col("x") * (F.col("all_docs") - F.col("docs"))
    return rows.where("asked = 1").select(F.col("x").alias("context_limit"), F.col("docs").alias("docs_that_fit"), kept.alias("kept_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"))


def quantiles(histogram: DataFrame, qs: list[float]) -> DataFrame:
    """The smallest length whose cumulative share of documents reaches each q; looked up like ``at_limits``."""
    wanted = histogram.sparkSession.createDataFrame([(float(q),) for q in sorted(set(qs))], "x double")
    both = histogram.select(F.col("cdf").alias("x"), F.lit(1).alias("known"), "n_tokens").unionByName(wanted.select("x", F.lit(0).alias("known"), F.lit(None).cast("long").alias("n_tokens")))
    down = W.orderBy("x", "known").rowsBetween(0, W.unboundedFollowing)
    found = both.select(F.col("x").alias("q"), "known", F.min("n_tokens").over(down).alias("n_tokens"))
    return found.where("known = 0 and n_tokens is not null").select("q", "n_tokens")
