"""Global and keyed running counts without one task holding the whole order.

A numeric order column is cut at its approximate quantiles, so that each range holds about as many rows however the values crowd. Sums per
range, a table of at most ``MOST_RANGES`` rows a key, are accumulated apart; the window function then works inside a range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import materialize

#: Rows and bytes a range holds, about, and most ranges.
RANGE_ROWS, RANGE_BYTES, MOST_RANGES = 200_000, 32 << 20, 4096


def _ranges(df: DataFrame) -> int:
    """How many ranges a written table needs: wide rows have fewer rows in theirs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(MOST_RANGES, max(df.count() // RANGE_ROWS, size // RANGE_BYTES)))


def _bucketed(df: DataFrame, order: str, buckets: int | None) -> DataFrame:
    """Adds ``_bucket``, rising with the order; nulls are in bucket -1."""
    buckets = buckets or _ranges(df)
    cuts: list[float] = []
    if buckets > 1:
        share = [(k + 1) / buckets for k in range(buckets - 1)]
        cuts = sorted(set(df.agg(F.percentile_approx(F.col(order).cast("double"), share, 10 * buckets).alias("c")).first().c or []))
    if not cuts:
        return df.withColumn("_bucket", F.when(F.col(order).isNull(), -1).otherwise(0))
    # how many cuts lie below: a search in a constant array by halves, a column a step, so that no step is computed twice
    table, value = F.expr("array(" + ", ".join(f"{float(c)!r}D" for c in cuts) + ")"), F.col(order).cast("double")
    out = df.withColumn("_bucket", F.when(F.col(order).isNull(), -1).otherwise(0))
    step = 1 << (len(cuts).bit_length() - 1)
    while step:
        probe = F.col("_bucket") + step
        out = out.withColumn("_bucket", F.when((F.col("_bucket") >= 0) & (probe <= len(cuts)) & (F.try_element_at(table, probe) < value), probe).otherwise(F.col("_bucket")))
        step //= 2
    return out


def running_sum(df: DataFrame, value: Column, order: str, ties: list[str], by: list[str], name: str, buckets: int | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """``name``: the sum of ``value`` up to and with the row, by ``order`` then ``ties``, inside ``by``. Nulls come first.

    ``sums``: the fields of ``value``, where it is a struct that is summed field by field. The rows are written once, since their
    ranges, the ranges' sums and the result each need them. ``buckets``: how many ranges, where the caller knows how many rows a key
    has; with one there is nothing to add up before, so nothing is written.
    """
    fields = [f"_value.{f}" for f in sums] or ["_value"]
    if buckets == 1:
        w = W.partitionBy(*by).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
        up = [F.sum(f).over(w) for f in fields]
        return df.withColumn("_value", value).withColumn(name, F.struct(*[c.alias(f) for c, f in zip(up, sums)]) if sums else up[0]).drop("_value")
    rows = _bucketed(materialize(df.withColumn("_value", value), "running"), order, buckets)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(f).alias(f"_sum{i}") for i, f in enumerate(fields)])
    earlier = W.partitionBy(*by).orderBy("_bucket")
    before = [(F.sum(f"_sum{i}").over(earlier) - F.col(f"_sum{i}")).alias(f"_before{i}") for i in range(len(fields))]
    totals = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_b"), *before)
    on = F.col("_bucket") == F.col("_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    w = W.partitionBy(*by, "_bucket").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    up = [F.sum(f).over(w) + F.col(f"_before{i}") for i, f in enumerate(fields)]
    out = rows.join(totals, on).withColumn(name, F.struct(*[c.alias(f) for c, f in zip(up, sums)]) if sums else up[0])
    return out.drop("_value", "_bucket", "_b", *[f"_before{i}" for i in range(len(fields))], *[f"_by_{c}" for c in by])


def row_numbers(df: DataFrame, order: str, ties: list[str] = [], name: str = "row", buckets: int | None = None) -> DataFrame:
    """Dense numbers from 1 in the order of ``order`` then ``ties``."""
    return running_sum(df, F.lit(1), order, ties, [], name, buckets)
