"""Quality classifier: Naive Bayes support vectors over hashed word and symbol 1- and 2-grams.

A document counts as good if its quality is labelled good and it isn't labelled toxic. Fitting takes at most ``sample`` labelled rows (a documented bound, chosen by a keyed hash of the id): their n-gram
indicators are scaled by class log-count ratios and a linear hinge-loss model is fitted by dual coordinate descent,
in one task of an executor. Only the weights, 2^18 numbers whatever the corpus, come to the driver and are broadcast; scoring is
one pass over the texts without a shuffle.

Defined results: rows with a null label do not train; an id labelled more than once counts by its mean, not at all where
that is a tie; a null toxicity is none; with fewer than one row of either class every score is 0. A null or empty text scores the model's bias. A document is
kept if its score is at least the threshold. Texts are scored whole whatever their length; repeated rows score alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, col, fresh, mix64, scan

SAMPLE, BITS, ALPHA, C, PASSES, THRESHOLD, SEED = 20_000, 18, 1.0, 1.0, 12, 0.0, 23


def indicators(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct (text, feature) of all 1- and 2-grams, and of their repetition."""
    docs, feats = [], []
    mask = np.uint64((1 << bits) - 1)
    for first, some in chunks(texts):
        h, doc, _, _ = scan(some, symbols=True)
        if not len(h):
            continue
        same = doc[1:] == doc[:-1]
        pairs = mix64(h[:-1] * np.uint64(3) + h[1:])[same]
        # one pattern stands for all 2-grams of a word with itself, one for all words that return after one other
        twice = doc[1:][same & (h[1:] == h[:-1])]
        back = doc[2:][(doc[2:] == doc[:-2]) & (h[2:] == h[:-2])]
        patterns = np.concatenate([np.full(len(twice), 1, np.uint64), np.full(len(back), 2, np.uint64)])
        d = np.concatenate([doc, doc[1:][same], twice, back]).astype(np.uint64)
        key = np.unique((d << np.uint64(bits)) | (np.concatenate([h, pairs, patterns]) & mask))
        docs.append((key >> np.uint64(bits)).astype(np.int64) + first)
        feats.append((key & mask).astype(np.int64))
    none = np.zeros(0, np.int64)
    return (np.concatenate(docs), np.concatenate(feats)) if docs else (none, none)


def log_count_ratios(doc: np.ndarray, feat: np.ndarray, y: np.ndarray, size: int, alpha: float = ALPHA) -> np.ndarray:
    p = alpha + np.bincount(feat, (y > 0)[doc].astype(float), size)
    q = alpha + np.bincount(feat, (y <= 0)[doc].astype(float), size)
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(values: list[np.ndarray], feats: list[np.ndarray], y: np.ndarray, size: int, c: float = C, passes: int = PASSES, seed: int = SEED, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + c * sum of hinge losses; the bias is the weight of a constant 1."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    q = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            v, f = values[i], feats[i]
            g = y[i] * (float(w[f] @ v) + b) - 1.0
            a = min(max(alpha[i] - g / q[i], 0.0), c)
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[f] += step * v
                b += step
                worst = max(worst, abs(a - alpha[i]))
                alpha[i] = a
        if worst < tolerance * c:
            break
    return w, b


def fit_rows(doc: np.ndarray, feat: np.ndarray, y: np.ndarray, size: int, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios r, weights w on unit-length scaled indicators, bias."""
    r = log_count_ratios(doc, feat, y, size)
    cuts = np.searchsorted(doc, np.arange(1, len(y)))
    feats = np.split(feat, cuts)
    values = [r[f] / (np.sqrt((r[f] ** 2).sum()) or 1.0) for f in feats]
    w, b = dual_coordinate_descent(values, feats, np.where(y > 0, 1.0, -1.0), size, **how)
    return r, w, b


class QualityModel:
    def __init__(self, r: np.ndarray, w: np.ndarray, bias: float):
        self.product, self.square, self.bias = r * w, r * r, float(bias)
        self.bits = len(r).bit_length() - 1

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        doc, feat = indicators(texts, self.bits)
        if len(doc):
            norm = np.sqrt(np.bincount(doc, self.square[feat], len(texts)))
            out += np.bincount(doc, self.product[feat], len(texts)) / np.where(norm > 0, norm, 1.0)
        return out

    def column(self, df: DataFrame, text: Column) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def quality(v: pa.Array) -> pa.Array:
            return pa.array(shared.value.score(v.to_pylist()))

        return quality.asNondeterministic()(text)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", reject_col: str | None = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS, **how) -> QualityModel:
    size = 1 << bits
    bad = col(reject_col).cast("double") if reject_col in labels.columns else F.lit(None).cast("double")
    mean = labels.select(col(id_col).alias("label_id"), col(label_col).cast("double").alias("y"), bad.alias("bad")).where("label_id is not null and y is not null")
    mean = mean.groupBy("label_id").agg(F.when(F.avg("bad") > 0.5, 0.0).otherwise(F.avg("y")).alias("y")).where("y <> 0.5")
    some = mean.orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id").limit(sample)
    # at most `sample` rows of an id and a number: small enough to broadcast whatever the corpus
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))

    @F.arrow_udf("array<int>")
    def features(v: pa.Array) -> pa.Array:
        doc, feat = indicators(v.to_pylist(), bits)
        ends = np.searchsorted(doc, np.arange(len(v)), "right")
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(feat.astype(np.int32)))

    def train(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "y"], kind="stable")
        y = np.where(pdf.y.to_numpy() > 0.5, 1.0, -1.0)
        doc = np.repeat(np.arange(len(pdf)), pdf.feats.map(len).to_numpy())
        feat = np.concatenate([np.asarray(x, np.int64) for x in pdf.feats]) if len(pdf) else np.zeros(0, np.int64)
        if len(set(y.tolist())) < 2:
            r, w, b = np.zeros(size), np.zeros(size), 0.0
        else:
            r, w, b = fit_rows(doc, feat, y, size, **how)
        return pd.DataFrame({"r": [r.astype(np.float32).tobytes()], "w": [w.astype(np.float32).tobytes()], "b": [b]})

    found = rows.select("doc_id", "y", features(F.col("text")).alias("feats")).groupBy(F.lit(0).alias("one")).applyInPandas(train, "r binary, w binary, b double").first()
    if found is None:
        return QualityModel(np.zeros(size), np.zeros(size), 0.0)
    return QualityModel(np.frombuffer(bytes(found.r), np.float32).astype(float), np.frombuffer(bytes(found.w), np.float32).astype(float), found.b)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every document."""
    return docs.select(col(id_col).alias("doc_id"), model.column(docs, col(text_col)).alias("score"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, model.column(docs, col(text_col))).where(col(score) >= threshold).drop(score)
