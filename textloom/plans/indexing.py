"""Queries of vocabularies, vectors and linear scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import indexing as I
from ..operators import models as M
from .base import COUNTS, TOKS, VOCAB, W_SQL, documents, table


def _feats(spark, d):
    return I.features(documents(spark, d), "w")


def _vocab(spark, d):
    return I.build_vocabulary(_feats(spark, d), 2)


def _counts(spark, d):
    return I.term_counts(I.array_counts(documents(spark, d), "w"), _vocab(spark, d))


def _word_counts(spark, d):
    """Term counts with the word itself for dim: what needs no ids."""
    return I.array_counts(documents(spark, d), "w").withColumnRenamed("feature", "dim")


def _n_docs(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"))


def vocab_build(spark, d):
    return _vocab(spark, d).select("dim", F.col("feature").alias("word"), "n_obs")


def index_term_counts(spark, d):
    return _counts(spark, d)


def chain_index(spark, d):
    counts = I.chain_term_counts(_feats(spark, d), _vocab(spark, d))
    return counts.groupBy("pos").agg(F.count("*").alias("links"), F.sum("dim").alias("dims"))


def vocab_invert(spark, d):
    used = table(spark, d, "documents").select((F.col("doc_id") * 3).cast("int").alias("dim"))
    return I.invert(used, _vocab(spark, d)).select("dim", F.col("feature").alias("word"))


def vocab_prune(spark, d):
    v = _vocab(spark, d)
    used = I.document_frequencies(I.term_counts(I.array_counts(documents(spark, d), "w"), v)).where("df >= 5")
    return I.prune(v, used).select("dim", F.col("feature").alias("word"))


def tfidf(spark, d):
    counts = _word_counts(spark, d)
    t = I.idf(I.document_frequencies(counts), _n_docs(spark, d))
    return I.tfidf(counts, t).select("doc_id", F.col("dim").alias("word"), F.round("value", 6).alias("value"))


def tfidf_running(spark, d):
    out = I.tfidf_running(_word_counts(spark, d), table(spark, d, "documents"))
    return out.select("doc_id", F.col("dim").alias("word"), F.round("value", 6).alias("value"))


def idf_min_docs(spark, d):
    freq = I.document_frequencies(_word_counts(spark, d))
    kept = I.idf(freq, _n_docs(spark, d), 3)
    return freq.join(kept.select("dim", "idf"), "dim", "left").select(F.col("dim").alias("word"), "df", F.round(F.coalesce("idf", F.lit(0.0)), 6).alias("idf"))


def w2v_sum(spark, d):
    """Sums of the vectors of each conversation's words; a word's vector is one of ``embeddings`` by arithmetic, and a seventh of them are unknown."""
    words = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), C.words(F.col("text")).alias("w"))
    feats = words.select("doc_id", F.explode("w").alias("feature"))
    key = (F.length("feature") * 31 + F.ascii("feature")) % 400
    vectors = feats.select("feature").distinct().withColumn("vec_id", key.cast("long")).where("vec_id % 7 <> 0").join(table(spark, d, "embeddings"), "vec_id").select("feature", "embedding")
    return I.embedding_sums(feats, vectors, ["doc_id"]).select(F.col("doc_id").alias("conv_id"), "i", F.round("value", 4).alias("value"))


def vector_concat(spark, d):
    """Word counts beside letter counts: the second block's dims follow the first one's."""
    docs = table(spark, d, "documents")
    first = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.length(c).cast("double").alias("value")) for i, c in enumerate(("lang", "source", "text"))])).alias("s")).select("doc_id", "s.*")
    second = docs.select("doc_id", F.lit(0).alias("dim"), F.col("n_chars").cast("double").alias("value"))
    return I.concatenate([(first, 3), (second, 1)])



def _weights(spark, d):
    """A weight for each word by arithmetic on its length and first letter: checkable in SQL."""
    words = _feats(spark, d).select(F.col("feature").alias("dim")).distinct()
    w = ((F.length("dim") * 37 + F.ascii("dim") * 11) % 201 - 100) / F.lit(500.0)
    return words.select("dim", w.alias("weight"))


def lr_score(spark, d):
    out = M.score_binary(_word_counts(spark, d), _weights(spark, d), 0.25)
    return out.select("doc_id", F.round("probability", 6).alias("probability"))


def softmax_score(spark, d):
    w = _weights(spark, d).select("dim", F.explode(F.array(F.struct(F.lit(1).alias("k"), (F.col("weight") / 10).alias("weight")), F.struct(F.lit(2).alias("k"), (-F.col("weight") / 20).alias("weight")))).alias("s")).select("dim", F.col("s.k").alias("class_id"), F.col("s.weight").alias("weight"))
    out = M.score_multiclass(_word_counts(spark, d), w, {1: 0.1, 2: -0.2})
    return out.select("doc_id", "class_id", F.round("probability", 6).alias("probability"))


def significant_features(spark, d):
    out = M.significant_features(_word_counts(spark, d), _weights(spark, d), 0.25, 0.6)
    return out.select("doc_id", F.col("dim").alias("word"), F.round("probability", 6).alias("probability"))


def used_features(spark, d):
    return _weights(spark, d).where("weight <> 0").select(F.col("dim").alias("word")).distinct()


QUERIES = {f.__name__: f for f in (vocab_build, index_term_counts, chain_index, vocab_invert, vocab_prune, tfidf, tfidf_running, idf_min_docs, w2v_sum, vector_concat, lr_score, softmax_score, significant_features, used_features)}

_WC = f"{TOKS}, wc AS (SELECT doc_id, word, count(*) AS tf FROM toks GROUP BY ALL)"
_WT = f"{_WC}, wt AS (SELECT DISTINCT word, ((length(word) * 37 + unicode(word) * 11) % 201 - 100) / 500.0::DOUBLE AS weight FROM wc)"
ORACLES = {
    "vocab_build": f"WITH {TOKS}, {VOCAB} SELECT dim, feature AS word, n_obs FROM vocab",
    "index_term_counts": f"WITH {TOKS}, {VOCAB}, {COUNTS} SELECT doc_id, dim, tf FROM tc",
    "chain_index": f"WITH {TOKS}, {VOCAB} SELECT CAST(pos AS INTEGER) AS pos, count(*) AS links, CAST(sum(dim) AS BIGINT) AS dims FROM toks JOIN vocab ON word = feature GROUP BY ALL",
    "vocab_invert": f"WITH {TOKS}, {VOCAB} SELECT CAST(doc_id * 3 AS INTEGER) AS dim, feature AS word FROM documents LEFT JOIN vocab ON dim = doc_id * 3",
    "vocab_prune": f"WITH {TOKS}, {VOCAB}, {COUNTS} SELECT dim, feature AS word FROM vocab WHERE dim IN (SELECT dim FROM tc GROUP BY dim HAVING count(*) >= 5)",
    "tfidf": f"WITH {_WC}, df AS (SELECT word, count(*) AS df FROM wc GROUP BY word) SELECT doc_id, word, round(tf * (ln((SELECT count(*) FROM documents)) - ln(df)), 6) AS value FROM wc JOIN df USING (word)",
    "tfidf_running": f"WITH {_WC}, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS df FROM wc) SELECT doc_id, word, round(tf * (ln(n) - ln(df)), 6) AS value FROM r JOIN n USING (doc_id)",
    "idf_min_docs": f"WITH {_WC} SELECT word, count(*) AS df, round(CASE WHEN count(*) >= 3 THEN ln((SELECT count(*) FROM documents)) - ln(count(*)) ELSE 0 END, 6) AS idf FROM wc GROUP BY word",
    "w2v_sum": f"WITH w AS (SELECT conv_id, unnest({W_SQL}) AS word FROM conversations), n AS (SELECT conv_id, (length(word) * 31 + unicode(word)) % 400 AS vec_id, count(*) AS k FROM w GROUP BY ALL), e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 7 <> 0) SELECT conv_id, CAST(i AS INTEGER) AS i, round(sum(k * x), 4) AS value FROM n JOIN e USING (vec_id) GROUP BY ALL",
    "vector_concat": "SELECT doc_id, 0 AS dim, CAST(length(lang) AS DOUBLE) AS value FROM documents UNION ALL SELECT doc_id, 1, CAST(length(source) AS DOUBLE) FROM documents UNION ALL SELECT doc_id, 2, CAST(length(text) AS DOUBLE) FROM documents UNION ALL SELECT doc_id, 3, CAST(n_chars AS DOUBLE) FROM documents",
    "lr_score": f"WITH {_WT} SELECT doc_id, round(1 / (1 + exp(-(sum(tf * weight) + 0.25))), 6) AS probability FROM wc JOIN wt USING (word) GROUP BY doc_id",
    "softmax_score": f"WITH {_WT}, m AS (SELECT doc_id, sum(tf * weight / 10) + 0.1 AS a, sum(tf * -weight / 20) - 0.2 AS b FROM wc JOIN wt USING (word) GROUP BY doc_id), z AS (SELECT *, greatest(0, a, b) AS t FROM m), e AS (SELECT doc_id, exp(-t) AS x, exp(a - t) AS y, exp(b - t) AS w FROM z) SELECT doc_id, 0 AS class_id, round(x / (x + y + w), 6) AS probability FROM e UNION ALL SELECT doc_id, 1, round(y / (x + y + w), 6) FROM e UNION ALL SELECT doc_id, 2, round(w / (x + y + w), 6) FROM e",
    "significant_features": f"WITH {_WT} SELECT doc_id, word, round(1 / (1 + exp(-(weight + 0.25))), 6) AS probability FROM wc JOIN wt USING (word) WHERE weight <> 0 AND 1 / (1 + exp(-(weight + 0.25))) >= 0.6",
    "used_features": f"WITH {_WT} SELECT word FROM wt WHERE weight <> 0",
}
