"""Many models' and rules' classifications of one document and label become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import FORCED, RULE, has_flag


def weighted_average(p: Column, n: Column) -> Column:
    """Mean probability by match count; 0 without matches."""
    return F.when(F.sum(n) > 0, F.sum(n * p) / F.sum(n)).otherwise(0.0)


def forced_only(classifications: DataFrame, by: list[str]) -> DataFrame:
    """Where any of a group is forced, only the forced ones stay."""
    any_forced = F.max(has_flag(F.col("flags"), FORCED).cast("int")).over(W.partitionBy(*by))
    return classifications.withColumn("_forced", any_forced).where((F.col("_forced") == 0) | has_flag(F.col("flags"), FORCED)).drop("_forced")


def gang_reduce(classifications: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, label, probability, match_count, flags)``: rules and models are averaged apart, then joined harmonically.

    ``2 * rules * models / (rules + models)``, 0 where both are. Match counts add up, flags are or-ed. One shuffle:
    both levels group by the same keys. Forced classifications shut out the others of their label.
    """
    forced, rule = has_flag(F.col("flags"), FORCED), has_flag(F.col("flags"), RULE)
    n, p = F.col("match_count"), F.col("probability")
    sums = lambda c: [F.sum(F.when(c & k, n)) for k in (rule, ~rule)] + [F.sum(F.when(c & k, n * p)) for k in (rule, ~rule)] + [F.max((c & k).cast("int")) for k in (rule, ~rule)]
    names = ("n_rule", "n_model", "s_rule", "s_model", "has_rule", "has_model")
    aggs = [x.alias(f"{a}_{k}") for a, c in (("forced", forced), ("any", F.lit(True))) for x, k in zip(sums(c), names)]
    flags = [F.bit_or(F.when(forced, F.col("flags"))).alias("forced_flags"), F.bit_or("flags").alias("any_flags"), F.max(forced.cast("int")).alias("is_forced")]
    g = classifications.groupBy(id_col, "label").agg(*aggs, *flags)
    pick = lambda k: F.when(F.col("is_forced") == 1, F.col(f"forced_{k}")).otherwise(F.col(f"any_{k}"))
    mean = lambda k: F.when(pick(f"n_{k}") > 0, pick(f"s_{k}") / pick(f"n_{k}")).otherwise(0.0)
    r, m = mean("rule"), mean("model")
    both = (pick("has_rule") == 1) & (pick("has_model") == 1)
    joined = F.when(both, F.when(r + m > 0, 2 * r * m / (r + m)).otherwise(0.0)).when(pick("has_rule") == 1, r).otherwise(m)
    count = F.coalesce(pick("n_rule"), F.lit(0)) + F.coalesce(pick("n_model"), F.lit(0))
    return g.select(id_col, "label", joined.alias("probability"), count.alias("match_count"), pick("flags").alias("flags"))


def ranked(classifications: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, predictions)``: each document's classifications by falling probability, then label."""
    items = F.collect_list(F.struct((-F.col("probability")).alias("k"), "label", "probability"))
    return classifications.groupBy(id_col).agg(F.transform(F.array_sort(items), lambda x: F.struct(x["label"].alias("label"), x["probability"].alias("probability"))).alias("predictions"))


def argmax_label(classifications: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, label, probability)``: the likeliest label, those over their threshold first; ties go to the smaller label."""
    rows = classifications
    if thresholds is not None:
        rows = rows.join(F.broadcast(thresholds), "label", "left")  # one row a label
        over = F.col("probability") >= F.coalesce("threshold", F.lit(default))
    else:
        over = F.lit(True)
    best = F.min(F.struct((~over).alias("under"), (-F.col("probability")).alias("p"), F.col("label")))
    return rows.groupBy(id_col).agg(best.alias("best")).select(id_col, "best.label", (-F.col("best.p")).alias("probability"))


def over_threshold(classifications: DataFrame, thresholds: DataFrame, default: float) -> DataFrame:
    rows = classifications.join(F.broadcast(thresholds), "label", "left")  # one row a label
    return rows.where(F.col("probability") >= F.coalesce("threshold", F.lit(default))).drop("threshold")


def close_enough(expected: DataFrame, found: DataFrame, keys: list[str], tolerance: float = 0.001) -> DataFrame:
    """Rows of a stored against a fresh prediction that differ: missing on a side, or in probability, match count or flags."""
    a, b = expected.alias("a"), found.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    same = (F.abs(F.col("a.probability") - F.col("b.probability")) < tolerance) & (F.col("a.match_count") == F.col("b.match_count")) & (F.col("a.flags") == F.col("b.flags"))
    return a.join(b, on, "full_outer").where(~F.coalesce(same, F.lit(False))).select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys])


def translate_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``name`` by ``label`` = ``uuid``; null where unknown. Labels are a small dimension table; Spark picks the join."""
    return predictions.join(labels.select(F.col("uuid").alias("label"), "name"), "label", "left")


def suggested_thresholds(cross_validated: DataFrame, trained: DataFrame) -> DataFrame:
    """``(label, threshold)``: the cross-validated threshold, else the trained one."""
    a, b = cross_validated.select("label", F.col("threshold").alias("x")), trained.select("label", F.col("threshold").alias("t"))
    return a.join(b, "label", "full_outer").select("label", F.coalesce("x", "t").alias("threshold"))
