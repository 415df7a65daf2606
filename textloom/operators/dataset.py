"""Training sets: labelled points, folds, portions, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import row_numbers


def keyed_hash(key: str, seed: int) -> Column:
    """60 bits of a digest of the seed and the key: the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def labelled_points_binary(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, label, y)`` of each annotation, y 1.0 or 0.0; annotations of spans are an error."""
    a = docs.select(F.col(id_col).alias("doc_id"), F.explode("annotations").alias("a"))
    fields = {f.name for f in docs.schema["annotations"].dataType.elementType.fields}
    y = F.col("a.is_positive").cast("double")
    if "offset" in fields:
        y = F.when(F.col("a.offset").isNotNull(), F.raise_error(F.lit("a classifier can't learn from spans"))).otherwise(y)
    return a.select("doc_id", F.col("a.label").alias("label"), y.alias("y"))


def class_ids(points: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(label, class_id)`` in the order labels first appear, ties by label."""
    first = points.groupBy("label").agg(F.min(order).alias("at"))
    return first.select("label", (F.row_number().over(W.orderBy("at", "label")) - 1).alias("class_id"))  # one row a label


def labelled_points_multiclass(points: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(doc_id, label, class_id)`` of positive annotations."""
    kept = points.where("y = 1.0")
    return kept.join(F.broadcast(class_ids(kept, order)), "label").select(order, "label", "class_id")


def label_distribution(points: DataFrame, label: str = "label") -> DataFrame:
    return points.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy("n", "label")


def ensure_two_classes(points: DataFrame) -> DataFrame:
    """With one class only, a copy of every row in the other class is added; with none it is an error."""
    ends = points.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if ends.lo is None:
        raise ValueError("no rows to learn from")
    return points if ends.lo != ends.hi else points.unionByName(points.withColumn("y", 1 - F.col("y")))


def balance_binary(points: DataFrame, tolerance: float = 0.66, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """The larger of two classes is thinned out if the smaller one is under ``tolerance`` of it; rows are chosen by a keyed hash, so reruns agree."""
    sizes = {r.y: r.n for r in points.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(sizes) != 2:
        raise ValueError("balancing takes exactly two classes")
    (small, a), (large, b) = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
    if a / b >= tolerance:
        return points
    chosen = F.pmod(keyed_hash(key, seed), F.lit(1_000_000)) < int(1_000_000 * a / b)
    return points.where((F.col("y") == small) | chosen)


def with_fold(docs: DataFrame, k: int, order: str = "doc_id") -> DataFrame:
    """Adds ``fold``: position in the order, modulo k."""
    return row_numbers(docs, order, [], "_row").withColumn("fold", F.pmod(F.col("_row") - 1, F.lit(k)).cast("int")).drop("_row")


def with_shuffled_fold(docs: DataFrame, k: int, seed: int = 42, order: str = "doc_id") -> DataFrame:
    """Adds ``fold``: folds of equal size, dealt in the order of a keyed hash; under 4k rows all are in fold 0."""
    hashed = docs.withColumn("_key", keyed_hash(order, seed))
    rows = row_numbers(hashed, "_key", [order], "_row")
    size = docs.agg(F.count("*").alias("_size"))
    fold = F.when(F.col("_size") < 4 * k, 0).otherwise(F.pmod(F.col("_row") - 1, F.lit(k))).cast("int")
    return rows.crossJoin(F.broadcast(size)).withColumn("fold", fold).drop("_row", "_key", "_size")  # one row


def split_fold(docs: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; where all rows are in one fold, all of them are both."""
    if fold == 0 and docs.where("fold <> 0").isEmpty():
        return docs, docs
    return docs.where(F.col("fold") != fold), docs.where(F.col("fold") == fold)


def prefix_portion(docs: DataFrame, portion: float, order: str = "doc_id") -> DataFrame:
    """The first ``floor(n * portion)`` documents."""
    size = docs.agg(F.floor(F.count("*") * F.lit(portion)).alias("_most"))
    return row_numbers(docs, order, [], "_row").crossJoin(F.broadcast(size)).where("_row <= _most").drop("_row", "_most")  # one row


def validation_sample(docs: DataFrame, k: int = 30, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first k documents of distinct text."""
    first = docs.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("_h")).agg(F.min(order).alias(order))
    return docs.join(F.broadcast(first.orderBy(order).limit(k).select(order)), order, "left_semi")  # k rows


def random_holdout(docs: DataFrame, portion: float, seed: int = 42, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Held-out and other rows by a keyed hash."""
    held = F.pmod(keyed_hash(key, seed), F.lit(1_000_000)) < int(portion * 1_000_000)
    return docs.where(held), docs.where(~held)


#: A positional deal is a list on the driver; beyond so many rows folds go by hash.
MOST_DEALT = 1_000_000


def dealt_folds(n: int, k: int, seed: int = 1) -> list[int]:
    """Folds of n rows in order: 0 ... k - 1 in turn, shuffled from the end by the JVM's 48-bit linear congruential generator."""
    if n > MOST_DEALT:
        raise ValueError(f"{n} rows are too many to deal by position; use with_shuffled_fold")
    state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(count: int) -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return state >> (48 - count)

    def below(m: int) -> int:
        if m & (m - 1) == 0:
            return (m * bits(31)) >> 31
        while True:
            r = bits(31)
            if r - r % m + m - 1 < 1 << 31:
                return r % m

    folds = [i % k for i in range(n)]
    for size in range(n, 1, -1):
        j = below(size)
        folds[size - 1], folds[j] = folds[j], folds[size - 1]
    return folds


def with_dealt_fold(docs: DataFrame, k: int, seed: int = 1, order: str = "doc_id") -> DataFrame:
    """Adds ``fold`` by ``dealt_folds`` in the order, for data whose folds have to be those of earlier runs; under 4k rows all are in fold 0."""
    n = docs.count()
    folds = dealt_folds(n, k, seed) if n >= 4 * k else [0] * n
    table = docs.sparkSession.createDataFrame(list(enumerate(folds, 1)), "_row long, fold int")
    return row_numbers(docs, order, [], "_row").join(table, "_row").drop("_row")


def merge_class_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(model, label, class_id)`` of either side, the second's where both have the label of a model."""
    on = ["model", "label"]
    a, b = first.select(*on, F.col("class_id").alias("_a")), second.select(*on, F.col("class_id").alias("_b"))
    return a.join(b, on, "full_outer").select(*on, F.coalesce("_b", "_a").alias("class_id"))
