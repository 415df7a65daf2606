"""What the query modules share: table access, SQL fragments and deterministic inputs for reductions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..scratch import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, over all cores: for what takes long on each text."""
    return spread(table(spark, sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their words ``w``."""
    return texts(spark, sf_dir).select("doc_id", "lang", C.words(F.col("text")).alias("w"))


W_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
TOKS = f"toks AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, lang, {W_SQL} AS w FROM documents))"
VOCAB = "seen AS (SELECT doc_id, pos, word, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY word) AS n_obs FROM toks), vocab AS (SELECT CAST(row_number() OVER (ORDER BY doc_id, pos) - 1 AS INTEGER) AS dim, word AS feature, n_obs FROM seen WHERE k = 2)"
COUNTS = "tc AS (SELECT doc_id, dim, count(*) AS tf FROM toks JOIN vocab ON word = feature GROUP BY ALL)"

#: Three models' and a rule's synthetic classifications of every document, by arithmetic on ids.
MODELS = [("m1", 37, 101, 0), ("m2", 53, 97, 0), ("rules", 29, 89, 2)]
LABELS = ("alpha", "beta", "gamma")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, model, label, probability, match_count, flags)``."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = []
    for m, a, b, flag in MODELS:
        for i, label in enumerate(LABELS):
            p = ((F.col("doc_id") * a + i * 17) % b) / F.lit(float(b - 1))
            n = 1 + (F.col("doc_id") + i) % 3
            flags = F.lit(flag) if not flag else F.when((F.col("doc_id") + i) % 11 == 0, 3).otherwise(2)
            rows.append(F.struct(F.lit(m).alias("model"), F.lit(label).alias("label"), p.alias("probability"), n.alias("match_count"), flags.alias("flags")))
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("s")).select("doc_id", "s.*")


def _scores_sql() -> str:
    parts = []
    for m, a, b, flag in MODELS:
        for i, label in enumerate(LABELS):
            flags = str(flag) if not flag else f"CASE WHEN (doc_id + {i}) % 11 = 0 THEN 3 ELSE 2 END"
            parts.append(f"SELECT doc_id, '{m}' AS model, '{label}' AS label, CAST((doc_id * {a} + {i * 17}) % {b} AS DOUBLE) / {float(b - 1)!r} AS probability, 1 + (doc_id + {i}) % 3 AS match_count, {flags} AS flags FROM documents")
    return "scores AS (" + " UNION ALL ".join(parts) + ")"


SCORES = _scores_sql()


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from order lines: a document is an order."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 30).cast("long").alias("offset"), F.floor("l_quantity").cast("long").alias("length"), F.col("l_returnflag").alias("label"),
        F.col("l_discount").alias("probability"), (F.col("l_partkey") % 4).cast("long").alias("flags"), F.col("l_partkey"), F.col("l_suppkey"),
    )


SPANS = "spans AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber * 30 AS BIGINT) AS \"offset\", CAST(floor(l_quantity) AS BIGINT) AS length, l_returnflag AS label, l_discount AS probability, CAST(l_partkey % 4 AS BIGINT) AS flags, l_partkey, l_suppkey FROM lineitem)"
