"""Trainers: a pipeline of features, a model for each label or one for all, evaluation, and what chooses between them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..scratch import discard, materialize
from . import dataset, indexing, metrics, models


@dataclass
class Featurizer:
    """Words to 1- ... ``most``-grams to term counts over a vocabulary fitted with a minimum number of observations."""

    least: int = 1
    most: int = 3
    minimum: int = 2
    vocabulary: DataFrame | None = None
    size: int = 0

    def _features(self, docs: DataFrame) -> DataFrame:
        words = docs.select("doc_id", C.words(F.col("text")).alias("w"))
        grams = words.select("doc_id", F.transform(C.ngrams(F.col("w"), self.least, self.most), C.display).alias("g"))
        return indexing.features(grams, "g")

    def fit(self, docs: DataFrame) -> "Featurizer":
        self.vocabulary = materialize(indexing.build_vocabulary(self._features(docs), self.minimum), "vocabulary")
        self.size = self.vocabulary.count()
        return self

    def counts(self, docs: DataFrame) -> DataFrame:
        if self.vocabulary is None:
            raise ValueError("the featurizer isn't fitted")
        return indexing.term_counts(self._features(docs), self.vocabulary, self.size)

    def vectors(self, docs: DataFrame) -> DataFrame:
        return models.to_vectors(self.counts(docs), max(self.size, 1))


@dataclass
class KBinary:
    """One binary model a label over one shared featurizer; unused features are pruned."""

    featurizer: Featurizer = field(default_factory=Featurizer)
    estimator: object = models.train_simple
    weights: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)
    scale: object = dataset.ensure_two_classes

    def fit(self, docs: DataFrame, points: DataFrame, labels: list[str] | None = None) -> "KBinary":
        """``docs`` ``(doc_id, text)``, ``points`` ``(doc_id, label, y)``; ``labels``: only these. The estimator may be one a label."""
        spark = docs.sparkSession
        vectors = materialize(self.featurizer.fit(docs).vectors(docs), "vectors")
        found = [r.label for r in points.select("label").distinct().orderBy("label").collect()]  # one row a label
        if isinstance(self.estimator, dict) and (missing := sorted(set(found) - set(self.estimator))):
            raise KeyError(f"no estimator for {missing}")
        for label in found if labels is None else [x for x in found if x in labels]:
            mine = self.scale(points.where(F.col("label") == label).select("doc_id", "y"))
            estimator = self.estimator[label] if isinstance(self.estimator, dict) else self.estimator
            m = estimator(vectors.join(mine, "doc_id"))
            self.weights[label] = (models.coefficients(spark, m), float(m.intercept))
        discard(vectors)
        used = metrics.union_all([w.select("dim") for w, _ in self.weights.values()])
        self.featurizer.vocabulary = materialize(indexing.prune(self.featurizer.vocabulary, used), "vocabulary")
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, label, probability, match_count, flags)`` of every document and label."""
        counts = materialize(self.featurizer.counts(docs), "counts")
        parts = []
        for label, (w, b) in self.weights.items():
            scored = docs.select("doc_id").join(models.score_binary(counts, w, b), "doc_id", "left")
            floor = 1 / (1 + F.exp(F.lit(-b)))
            parts.append(scored.select("doc_id", F.lit(label).alias("label"), F.coalesce("probability", floor).alias("probability"), F.lit(1).alias("match_count"), F.lit(0).alias("flags")))
        return metrics.union_all(parts)

    def tables(self) -> dict[str, DataFrame]:
        rows = [w.select(F.lit(l).alias("label"), "dim", "weight") for l, (w, _) in self.weights.items()]
        spark = self.featurizer.vocabulary.sparkSession
        heads = spark.createDataFrame([(l, b) for l, (_, b) in self.weights.items()], "label string, intercept double")
        return {"vocabulary": self.featurizer.vocabulary, "weights": metrics.union_all(rows), "labels": heads}

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame], **featurizer) -> "KBinary":
        f = Featurizer(vocabulary=tables["vocabulary"], **featurizer)
        m = cls(featurizer=f)
        for r in tables["labels"].orderBy("label").collect():  # one row a label
            m.weights[r.label] = (tables["weights"].where(F.col("label") == r.label).select("dim", "weight"), r.intercept)
        return m


@dataclass
class MultiClass:
    """One multinomial model for all labels."""

    featurizer: Featurizer = field(default_factory=Featurizer)
    params: dict = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    weights: DataFrame | None = None
    intercepts: dict[int, float] = field(default_factory=dict)

    def fit(self, docs: DataFrame, points: DataFrame) -> "MultiClass":
        ids = dataset.class_ids(points.where("y = 1.0")).orderBy("class_id").collect()  # one row a label
        self.labels = [r.label for r in ids]
        classes = dataset.labelled_points_multiclass(points).select("doc_id", F.col("class_id").cast("double").alias("y"))
        rows = self.featurizer.fit(docs).vectors(docs).join(classes, "doc_id")
        w, self.intercepts = models.train_multiclass(rows, max(2, len(self.labels)), **self.params)
        self.weights = models.class_weights(docs.sparkSession, w)
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        scored = models.score_multiclass(self.featurizer.counts(docs), self.weights, self.intercepts)
        # a document without a known feature is scored by the intercepts
        e = {0: 1.0} | {k: math.exp(b) for k, b in self.intercepts.items()}
        rows = F.array(*[F.struct(F.lit(k).alias("class_id"), F.lit(v / sum(e.values())).alias("probability")) for k, v in e.items()])
        bare = docs.select("doc_id").join(scored.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")
        scored = scored.unionByName(bare)
        names = F.array(*[F.lit(l) for l in self.labels])
        return scored.where(F.col("class_id") < len(self.labels)).select("doc_id", F.get(names, F.col("class_id")).alias("label"), "probability", F.lit(1).alias("match_count"), F.lit(0).alias("flags"))


@dataclass
class BestPipelines:
    """Several makers of models a label; each label keeps that whose model scores rows it wasn't trained on best, by AUROC, the first of equals."""

    makers: dict[str, object]
    hold_out: float = 0.2
    chosen: dict[str, str] = field(default_factory=dict)
    models: dict[str, KBinary] = field(default_factory=dict)

    def select(self, docs: DataFrame, points: DataFrame) -> DataFrame:
        """``(label, pipeline, auroc)``; where no row is held out, or of one class only, rows of training are scored."""
        held, rest = dataset.random_holdout(docs, self.hold_out)
        if held.isEmpty() or rest.isEmpty():
            held = rest = docs
        results = []
        for name, make in self.makers.items():
            m = make().fit(rest, points.join(rest.select("doc_id"), "doc_id", "left_semi"))
            scored = materialize(m.predict(held).join(points, ["doc_id", "label"]).select("label", F.col("probability").alias("score"), (F.col("y") == 1).alias("positive")), "scored")
            results += [(label, name, metrics.auroc(scored.where(F.col("label") == label).select("score", "positive")).first().auroc) for label in m.weights]
            discard(scored)
        return models.best_pipeline(results, docs.sparkSession)

    def fit(self, docs: DataFrame, points: DataFrame) -> "BestPipelines":
        self.chosen = {r.label: r.pipeline for r in self.select(docs, points).collect()}  # one row a label
        for name, make in self.makers.items():
            mine = [label for label, p in self.chosen.items() if p == name]
            if mine:
                self.models[name] = make().fit(docs, points, mine)
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        return metrics.union_all([m.predict(docs) for m in self.models.values()])


def evaluate(predictions: DataFrame, points: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(metric_type, metric_class, label, x, value)`` of predictions against ``(doc_id, label, y)``."""
    j = points.join(predictions, ["doc_id", "label"]).select("label", (F.col("y") == 1).alias("g"), (F.col("probability") >= threshold).alias("p"))
    n = lambda c: F.sum(c.cast("long"))
    counts = j.groupBy("label").agg(n(F.col("g") & F.col("p")).alias("tp"), n(~F.col("g") & F.col("p")).alias("fp"), n(F.col("g") & ~F.col("p")).alias("fn"))
    per = metrics.prf_by_label(counts)
    by = F.array(*[F.struct(F.lit(m).alias("metric_type"), F.col(c).alias("value")) for m, c in (("LabelPrecision", "precision"), ("LabelRecall", "recall"), ("LabelF1", "f1"))])
    labelled = per.select("label", F.explode(by).alias("m")).select("m.metric_type", "label", "m.value")
    whole = metrics.micro_macro(counts)
    rows = F.array(*[F.struct(F.lit(m).alias("metric_type"), F.lit(None).cast("string").alias("label"), F.col(c).alias("value")) for m, c in (("F1", "micro_f1"), ("MacroF1", "macro_f1"))])
    out = labelled.unionByName(whole.select(F.explode(rows).alias("m")).select("m.*"))
    return out.select("metric_type", F.lit("Model").alias("metric_class"), "label", F.lit(0.0).alias("x"), "value")


def _evaluate(docs: DataFrame, predicted: DataFrame, points: DataFrame) -> DataFrame:
    return evaluate(predicted, points)


def train_and_evaluate(make, train_docs: DataFrame, test_docs: DataFrame, points: DataFrame, evaluator=_evaluate) -> DataFrame:
    """Metrics of one model on rows it wasn't trained on and on those it was: ``summary`` TEST and TRAIN."""
    own = lambda docs: points.join(docs.select("doc_id"), "doc_id", "left_semi")
    model = make().fit(train_docs, own(train_docs))
    parts = [evaluator(d, model.predict(d), own(d)).withColumn("summary", F.lit(name)) for name, d in (("TEST", test_docs), ("TRAIN", train_docs))]
    return metrics.union_all(parts)


def cross_validate(make, docs: DataFrame, points: DataFrame, folds: int = 5, portion: float = 1.0, evaluator=_evaluate, assign=dataset.with_shuffled_fold) -> DataFrame:
    """Metrics averaged over folds; each fold's training set is cut to its first ``portion``. ``assign`` gives documents their folds."""
    folded = materialize(assign(docs, folds), "folds")
    found = []
    for k in range(folds):
        train, test = dataset.split_fold(folded, k)
        if portion < 1:
            train = dataset.prefix_portion(train, portion)
        model = make().fit(train, points.join(train.select("doc_id"), "doc_id", "left_semi"))
        # a fold's metrics are a few rows a label: written, so that the average doesn't run the fold again
        found.append(materialize(evaluator(test, model.predict(test), points.join(test.select("doc_id"), "doc_id", "left_semi")), "metrics"))
        if folded.where(f"fold = {k + 1}").isEmpty():
            break
    return metrics.average_metrics(metrics.union_all(found))


def learning_curve(make, docs: DataFrame, points: DataFrame, portions: list[float], folds: int = 5, evaluator=_evaluate, assign=dataset.with_shuffled_fold) -> DataFrame:
    runs = [cross_validate(make, docs, points, folds, p, evaluator, assign).withColumn("portion", F.lit(p)) for p in portions]
    return metrics.learning_curve(metrics.union_all(runs))


def compete(makers: dict, docs: DataFrame, points: DataFrame, folds: int = 2, evaluator=_evaluate, assign=dataset.with_shuffled_fold) -> DataFrame:
    """``(name, f1)`` of the trainer with the best averaged F1."""
    runs = [cross_validate(m, docs, points, folds, 1.0, evaluator, assign).where("metric_type = 'F1'").select(F.lit(name).alias("name"), F.col("value").alias("f1")) for name, m in makers.items()]
    return metrics.winner(metrics.union_all(runs))


@dataclass
class Rates:
    """The plainest model: a label's share of positive rows among the training documents of the same key, of all where the key is new."""

    key: object
    table: DataFrame | None = None

    def fit(self, docs: DataFrame, points: DataFrame) -> "Rates":
        rows = points.join(docs.select("doc_id", self.key.alias("_key")), "doc_id")
        self.table = materialize(rows.rollup("label", "_key").agg(F.avg("y").alias("rate"), F.grouping("_key").alias("_all")).where("label is not null"), "rates")
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        every = self.table.where("_all = 1").select("label", F.col("rate").alias("_rest"))
        own = self.table.where("_all = 0").select("label", "_key", "rate")
        # labels are few: one row each
        rows = docs.select("doc_id", self.key.alias("_key")).crossJoin(F.broadcast(every)).join(own, ["label", "_key"], "left")
        return rows.select("doc_id", "label", F.coalesce("rate", "_rest").alias("probability"), F.lit(1).alias("match_count"), F.lit(0).alias("flags"))


def inject_rules(model_predictions: DataFrame, rule_predictions: DataFrame | None) -> DataFrame:
    """A model's predictions with its rules replaced: earlier rules' results go, the new ones join."""
    kept = model_predictions.where(~C.has_flag(F.col("flags"), C.RULE))
    return kept if rule_predictions is None else kept.unionByName(rule_predictions)
