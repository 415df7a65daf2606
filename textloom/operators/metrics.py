"""Evaluation measures as aggregations; zero denominators give 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import running_sum


def safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def _prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    p, r = safe(F.col(tp), F.col(tp) + F.col(fp)), safe(F.col(tp), F.col(tp) + F.col(fn))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", safe(2 * p * r, p + r))


def confusion(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """``(gold, predicted, n)``."""
    return pairs.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def counts_by_label(pairs: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn)`` of single-label pairs ``(gold, predicted)``."""
    hit = F.col("gold") == F.col("predicted")
    sides = F.array(
        F.struct(F.col("gold").alias("label"), hit.cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~hit).cast("long").alias("fn")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), (~hit).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    return pairs.select(F.explode(sides).alias("s")).groupBy("s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))


def prf_by_label(counts: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn, precision, recall, f1)``; labels without any count drop out."""
    return _prf(counts.where("tp + fp + fn > 0"))


def micro_macro(counts: DataFrame) -> DataFrame:
    """One row: micro and macro precision, recall and F1."""
    per = prf_by_label(counts)
    g = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    g = g.fillna(0, ["tp", "fp", "fn"])
    return _prf(g).select(*[F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")], "macro_precision", "macro_recall", "macro_f1")


def multiclass(pairs: DataFrame) -> DataFrame:
    """Long form ``(metric, label, value)``: accuracy under its three names, weighted and per-label measures, false positive rates."""
    counts = counts_by_label(pairs)
    total = F.sum("support").over(W.partitionBy())
    per = prf_by_label(counts).withColumn("support", F.col("tp") + F.col("fn")).withColumn("total", total)
    per = per.withColumn("fpr", safe(F.col("fp"), F.col("total") - F.col("support")))
    by = [F.struct(F.lit(f"Label{m}").alias("metric"), F.col("label"), F.col(c).alias("value")) for m, c in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("FalsePositiveRate", "fpr"))]
    labelled = per.select(F.explode(F.array(*by)).alias("m")).select("m.*")
    share = F.col("support") / F.col("total")
    whole = per.agg(safe(F.sum("tp").cast("double"), F.max("total")).alias("acc"), *[F.sum(share * F.col(c)).alias(c) for c in ("precision", "recall", "f1", "fpr")])
    none = F.lit(None).cast("string")
    rows = [F.struct(F.lit(n).alias("metric"), none.alias("label"), F.coalesce(F.col(c), F.lit(0.0)).alias("value")) for n, c in (("Precision", "acc"), ("Recall", "acc"), ("F1", "acc"), ("WeightedPrecision", "precision"), ("WeightedRecall", "recall"), ("WeightedF1", "f1"), ("WeightedFalsePositiveRate", "fpr"))]
    return labelled.unionByName(whole.select(F.explode(F.array(*rows)).alias("m")).select("m.*"))


def multilabel(sets: DataFrame, n_labels: int) -> DataFrame:
    """One row from ``(gold, predicted)`` arrays: precision, recall, f1, accuracy (means over documents), subset accuracy, Hamming loss, micro measures."""
    g, p = F.size("gold"), F.size("predicted")
    both = F.size(F.array_intersect("gold", "predicted"))
    union = F.size(F.array_union("gold", "predicted"))
    return sets.agg(
        F.avg(safe(both, p)).alias("precision"), F.avg(safe(both, g)).alias("recall"), F.avg(safe(2 * both, g + p)).alias("f1"), F.avg(F.when(union > 0, both / union).otherwise(1.0)).alias("accuracy"),
        F.avg(((both == g) & (both == p)).cast("double")).alias("subset_accuracy"), F.avg((g + p - 2 * both) / F.lit(float(n_labels))).alias("hamming_loss"),
        safe(F.sum(both).cast("double"), F.sum(p)).alias("micro_precision"), safe(F.sum(both).cast("double"), F.sum(g)).alias("micro_recall"), safe(2.0 * F.sum(both), F.sum(g) + F.sum(p)).alias("micro_f1"),
    )


def multilabel_by_label(sets: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn, precision, recall, f1)`` of ``(gold, predicted)`` arrays."""
    rows = sets.select("gold", "predicted", F.explode(F.array_union("gold", "predicted")).alias("label"))
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("predicted", F.col("label"))
    n = lambda c: F.sum(c.cast("long"))
    return prf_by_label(rows.groupBy("label").agg(n(g & p).alias("tp"), n(~g & p).alias("fp"), n(g & ~p).alias("fn")))


def threshold_curve(scored: DataFrame) -> DataFrame:
    """``(score, tp, fp, pos, neg)`` at each distinct score taken as threshold, from ``(score, positive)``.

    Scores are counted first, and summed up in ranges, so no task holds all of them, be they all different.
    """
    hist = scored.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count("*").alias("n"))
    hist = hist.select("score", (-F.col("score")).alias("order"), "p", (F.col("n") - F.col("p")).alias("q"))
    up = running_sum(hist, F.struct("p", "q"), "order", [], [], "up", sums=("p", "q"))
    totals = hist.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("neg"))
    return up.crossJoin(F.broadcast(totals)).select("score", F.col("up.p").alias("tp"), F.col("up.q").alias("fp"), "pos", "neg")  # one row


def best_f1_threshold(scored: DataFrame) -> DataFrame:
    """``(threshold, f1)``: the threshold of the best F1, the highest of equals. Exact, not binned."""
    f1 = threshold_curve(scored).select("score", safe(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"))
    best = F.max(F.struct("f1", "score"))
    return f1.agg(best.alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def roc(scored: DataFrame) -> DataFrame:
    """``(threshold, fpr, tpr, precision, recall, f1)`` for every threshold."""
    c = threshold_curve(scored)
    return c.select(F.col("score").alias("threshold"), safe(F.col("fp"), F.col("neg")).alias("fpr"), safe(F.col("tp"), F.col("pos")).alias("tpr"), safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("pos")).alias("recall"), safe(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"))


def auroc(scored: DataFrame) -> DataFrame:
    """One row ``(auroc)``: area by trapezoids over distinct scores."""
    c = threshold_curve(scored).join(scored.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count("*").alias("n")), "score")
    # each score's own trapezoid: its width is its negatives, its height the mean of the positives before and with it
    area = (F.col("n") - F.col("p")) * (2 * F.col("tp") - F.col("p")) / 2.0
    return c.select(area.alias("a"), "pos", "neg").agg(safe(F.sum("a"), F.max("pos") * F.max("neg")).alias("auroc"))


def label_probabilities(scores: DataFrame) -> DataFrame:
    """``(label, rank, probability)``: each label's probabilities ascending, ranks from 0; equal ones are counted before they are ranked."""
    hist = scores.groupBy("label", "probability").agg(F.count("*").alias("n"))
    ranked = running_sum(hist, F.col("n"), "probability", [], ["label"], "upto")
    rows = ranked.select("label", "probability", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("rank"))
    return rows.select("label", F.col("rank").cast("int").alias("rank"), "probability")


def confidence_deciles(scores: DataFrame) -> DataFrame:
    """``(label, decile, probability)``: nine cut points of each label's ascending probabilities.

    The cut's 0-based rank is ``max(q - 1, 0) + (i - 1) * q + i * r div 10``, q = n div 10, r = n mod 10. Equal
    probabilities are counted first, so ranks are sums over distinct values.
    """
    hist = scores.groupBy("label", "probability").agg(F.count("*").alias("n"))
    totals = scores.groupBy("label").agg(F.count("*").alias("total"))  # one row a label
    hist = running_sum(hist, F.col("n"), "probability", [], ["label"], "upto").join(F.broadcast(totals), "label")
    q, r = F.floor(F.col("total") / 10), F.col("total") % 10
    cuts = F.array(*[F.struct(F.lit(i).alias("decile"), (F.greatest(q - 1, F.lit(0)) + (i - 1) * q + F.floor(i * r / 10)).alias("rank")) for i in range(1, 10)])
    hit = hist.withColumn("c", F.explode(cuts)).where((F.col("c.rank") < F.col("upto")) & (F.col("c.rank") >= F.col("upto") - F.col("n")))
    return hit.select("label", F.col("c.decile").alias("decile"), "probability")


def confidence_minmax(scores: DataFrame) -> DataFrame:
    return scores.groupBy("label").agg(F.min("probability").alias("least"), F.max("probability").alias("most"))


def average_metrics(metrics: DataFrame) -> DataFrame:
    """Means over folds of long-form metrics ``(metric_type, metric_class, label, x, value)``."""
    return metrics.groupBy("metric_type", "metric_class", "label", "x").agg(F.avg("value").alias("value"))


def average_counts(counts: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """Means over folds of whole numbers (label counts, cells of a confusion matrix), cut to whole numbers."""
    return counts.groupBy(*by).agg(F.floor(F.avg(value)).cast("long").alias(value))


def concatenate_values(lists: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The folds' values of a list metric together, as rows ``(by, rank, value)`` in ascending order."""
    hist = lists.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_sum(hist, F.col("n"), value, [], by, "upto")
    return ranked.select(*by, F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("rank"), value)


def display_order(metrics: DataFrame) -> DataFrame:
    """Metrics in the order they are shown in: by type, then class, then label."""
    return metrics.orderBy("metric_type", "metric_class", F.col("label").asc_nulls_first(), "x")


def learning_curve(metrics: DataFrame, types: tuple[str, ...] = ("LabelF1", "LabelPrecision", "LabelRecall", "F1")) -> DataFrame:
    """``(metric_type, label, points)`` of averaged metrics by portion, points ascending by portion."""
    kept = metrics.where(F.col("metric_type").isin(*types))
    return kept.groupBy("metric_type", "label").agg(F.array_sort(F.collect_list(F.struct("portion", "value"))).alias("points"))


def winner(results: DataFrame) -> DataFrame:
    """``(name, f1)`` of the best model; 0 where a model has no F1; of equals the smaller name."""
    best = F.min(F.struct((-F.coalesce("f1", F.lit(0.0))).alias("k"), F.col("name")))
    return results.agg(best.alias("b")).select(F.col("b.name").alias("name"), (-F.col("b.k")).alias("f1"))


def span_counts(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """``(label, tp, fp, fn)`` by exact match on ``keys`` and label, from a full outer join: labels of either side are there."""
    on = [*keys, "label"]
    g, p = gold.select(*on).distinct().withColumn("g", F.lit(1)), predicted.select(*on).distinct().withColumn("p", F.lit(1))
    both = g.join(p, on, "full_outer")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    gi, pi = F.col("g").isNotNull(), F.col("p").isNotNull()
    return both.groupBy("label").agg(n(gi & pi).alias("tp"), n(~gi & pi).alias("fp"), n(gi & ~pi).alias("fn"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
