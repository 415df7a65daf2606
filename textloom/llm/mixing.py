"""Time-varying data mixing: training positions from each source's weight schedule.

A schedule gives a source's weight at knots of training time in [0, 1]. At every knot the weights are divided by
their sum; between knots shares run linearly, so they sum to 1 everywhere, and a source's cumulative demand is
their integral, piecewise quadratic. A source's documents follow each other in the order of a keyed hash; the
document that fills the source's tokens from c to c + n is read when the demand reaches c, so its training
position solves ``demand(position) * budget = c``. Where a source holds less than its demand, its documents
start over (``epoch``) as often as the demand asks, or up to ``max_epochs`` times if given; where it holds more, the rest is not read. The budget is the
corpus's number of tokens unless given.

A source's documents are spread over 4096 hash buckets: running sums are taken inside a bucket, bucket totals are
summed up apart, so no task ever holds a whole source. Range-sorting by position ends the plan. Texts are counted once, and what is
known of them written to the shared folder; where columns are carried, texts are counted twice instead, for the totals and for
the rows, which takes less than to write them.

Defined results: a null source is a source of its own, of default weight. A null or empty text has no tokens and
is left out, as is a source whose weight is nowhere above 0. Texts count whole whatever their length. Ties of the hash go by id. Repeated
rows are read one after another. An empty table has no positions. A carried column that is named like one of the result's comes
out under that name with underscores before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, materialize

#: source: ((time, weight), ...), times ascending from 0 to 1; sources without a schedule weigh DEFAULT throughout.
SCHEDULES = {
    "src0": ((0.0, 6.0), (0.5, 3.0), (1.0, 1.0)),
    "src1": ((0.0, 0.5), (0.5, 1.0), (1.0, 3.0)),
    "src2": ((0.0, 1.0), (1.0, 2.0)),
    "src3": ((0.0, 0.0), (0.6, 0.5), (1.0, 2.0)),
}
DEFAULT, SEED = 1.0, "mix-1"


def count_words(text: Column) -> Column:
    """Tokens of a text for mixing: its runs of non-space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _knots(schedules) -> list[float]:
    times = sorted({0.0, 1.0, *(float(t) for s in schedules.values() for t, _ in s)})
    if times[0] < 0 or times[-1] > 1:
        raise ValueError("times lie in [0, 1]")
    return times


def _weight(points, t: float) -> float:
    before = [p for p in points if p[0] <= t] or [points[0]]
    after = [p for p in points if p[0] >= t] or [points[-1]]
    (a, x), (b, y) = before[-1], after[0]
    return float(x if a == b else x + (y - x) * (t - a) / (b - a))


def segments(sources: DataFrame, schedules=SCHEDULES, default: float = DEFAULT) -> DataFrame:
    """``(source, t0, t1, s0, s1, d0, d1)``: of each stretch between knots the shares at its ends and the demand up to them."""
    times = _knots(schedules)
    table = F.array(*[F.lit(float(default)) for _ in times])
    for name, points in schedules.items():
        table = F.when(F.col("source") == name, F.array(*[F.lit(_weight(points, t)) for t in times])).otherwise(table)
    at = sources.select("source", F.posexplode(table).alias("k", "weight"))
    total = at.groupBy("k").agg(F.sum("weight").alias("total"))
    share = at.join(total, "k").select("source", "k", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0).alias("s0"))
    w = W.partitionBy("source").orderBy("k")
    knots = F.array(*[F.lit(t) for t in times])
    seg = share.select("source", "s0", F.lead("s0").over(w).alias("s1"), knots[F.col("k")].alias("t0"), F.lead(knots[F.col("k")]).over(w).alias("t1"), "k").where("s1 is not null")
    area = (F.col("t1") - F.col("t0")) * (F.col("s0") + F.col("s1")) / 2
    return seg.withColumn("d1", F.sum(area).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("d0", F.col("d1") - area).drop("k")


def invert(x: Column) -> Column:
    """The time at which the demand of a segment ``(t0, t1, s0, s1, d0, d1)`` reaches x: the root of a quadratic, in the form that is stable for equal shares."""
    length, rest = F.col("t1") - F.col("t0"), F.greatest(x - F.col("d0"), F.lit(0.0))
    slope = (F.col("s1") - F.col("s0")) / length
    root = F.sqrt(F.greatest(F.col("s0") * F.col("s0") + 2 * slope * rest, F.lit(0.0)))
    below = F.col("s0") + root
    return F.col("t0") + F.least(length, F.when(below > 0, 2 * rest / below).otherwise(0.0))


def mix(docs: DataFrame, schedules=SCHEDULES, default: float = DEFAULT, budget: int | None = None, max_epochs: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, epoch, n_tokens, position)`` and the ``carry`` columns, range-sorted by position."""
    if max_epochs is not None and max_epochs < 1:
        raise ValueError("max_epochs is at least 1")
    given, out_names = [f"c{i}" for i in range(len(carry))], ["doc_id", "source", "epoch", "n_tokens", "position"]
    for c in carry:
        while c.lower() in {n.lower() for n in out_names}:
            c = f"_{c}"
        out_names.append(c)
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), count_words(col(text_col)).alias("n"), *[col(c).alias(g) for c, g in zip(carry, given)])
    # the generator keeps the filter from counting each text once more
    rows = rows.select("doc_id", "source", F.explode_outer(F.array("n")).alias("n_tokens"), *given).where("n_tokens > 0")
    # nulls keyed apart: on a null-safe join the window below would not find its partitioning again
    rows = rows.withColumn("mix", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("order_key", key).withColumn("bucket", F.substring("order_key", 1, 3))
    if not carry:
        rows = materialize(rows, "counted")
    totals = materialize(rows.groupBy("mix", "bucket").agg(F.first("source").alias("source"), F.sum("n_tokens").alias("in_bucket")), "totals")
    before = F.sum("in_bucket").over(W.partitionBy("mix").orderBy("bucket")) - F.col("in_bucket")
    totals = totals.select("mix", "bucket", "source", before.alias("before"), F.sum("in_bucket").over(W.partitionBy("mix")).alias("supply"))
    supplies = totals.groupBy("mix").agg(F.first("source").alias("source"), F.first("supply").alias("supply"))
    tokens = F.lit(int(budget)) if budget is not None else F.coalesce(F.sum("supply").over(W.partitionBy()), F.lit(0))
    supplies = supplies.select("mix", "source", tokens.alias("budget"))
    # one row a source, the stretches as an array: a document then finds its stretch without a range join
    seg = segments(supplies.select("source"), schedules, default).withColumn("mix", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    parts = seg.groupBy("mix").agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "s0", "s1", "d0", "d1"))).alias("parts"), F.max("d1").alias("demand"))
    # what a document needs to know of its bucket and source, joined to the texts in one go: they move once for it, once to be sorted
    known = totals.drop("source").join(parts.join(supplies.drop("source"), "mix"), "mix")
    w = W.partitionBy("mix", "bucket").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    r = rows.join(known, ["mix", "bucket"])
    r = r.withColumn("start", F.sum("n_tokens").over(w) - F.col("n_tokens") + F.col("before"))
    asked = F.ceil((F.col("demand") * F.col("budget") - F.col("start")) / F.col("supply")).cast("double")
    epochs = (asked if max_epochs is None else F.least(F.lit(max_epochs).cast("double"), asked)).cast("int")
    r = r.where(F.col("demand") > 0).withColumn("epochs", epochs).where("epochs >= 1")
    # by thousands first: no array grows with the number of epochs of a very small source
    r = r.withColumn("thousand", F.explode(F.sequence(F.lit(0), F.floor((F.col("epochs") - 1) / 1000).cast("int"))))
    r = r.withColumn("epoch", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("thousand") * 1000 + 999, F.col("epochs") - 1))))
    x = (F.col("start") + F.col("epoch") * F.col("supply")) / F.col("budget")
    r = r.withColumn("x", x).where("x < demand")
    part = F.element_at(F.filter("parts", lambda p: p["d1"] > F.col("x")), 1)
    r = r.withColumn("part", part)
    r = r.select("*", *[F.col(f"part.{c}").alias(c) for c in ("t0", "t1", "s0", "s1", "d0", "d1")]).withColumn("position", invert(F.col("x")))
    out = r.select("doc_id", "source", "epoch", "n_tokens", "position", *[F.col(g).alias(n) for g, n in zip(given, out_names[5:])])
    return out.orderBy("position", "doc_id", "epoch")


def oracle(schedules=SCHEDULES, default: float = DEFAULT, seed: str = SEED) -> str:
    times = _knots(schedules)
    values = ", ".join(f"('{n}', {i}, {_weight(p, t)!r})" for n, p in schedules.items() for i, t in enumerate(times))
    knots = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(times))
    return f"""
    WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS n_tokens, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
    placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS start, sum(n_tokens) OVER (PARTITION BY source) AS supply, sum(n_tokens) OVER () AS budget FROM docs WHERE n_tokens > 0),
    given(source, i, w) AS (VALUES {values}), knots(i, t) AS (VALUES {knots}),
    weights AS (SELECT s.source, k.i, k.t, coalesce(g.w, {default!r})::DOUBLE AS w FROM (SELECT DISTINCT source FROM placed) s CROSS JOIN knots k LEFT JOIN given g ON g.source = s.source AND g.i = k.i),
    shares AS (SELECT source, i, t, w / sum(w) OVER (PARTITION BY i) AS s FROM weights),
    led AS (SELECT source, i, t AS t0, lead(t) OVER o AS t1, s AS s0, lead(s) OVER o AS s1 FROM shares WINDOW o AS (PARTITION BY source ORDER BY i)),
    seg AS (SELECT *, (t1 - t0) * (s0 + s1) / 2 AS area, sum((t1 - t0) * (s0 + s1) / 2) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS d1 FROM led WHERE t1 IS NOT NULL),
    demand AS (SELECT source, max(d1) AS demand FROM seg GROUP BY source),
    each AS (SELECT p.doc_id, p.source, e.epoch, p.n_tokens, (p.start + e.epoch * p.supply)::DOUBLE / p.budget AS x, d.demand FROM placed p JOIN demand d ON d.source IS NOT DISTINCT FROM p.source CROSS JOIN LATERAL (SELECT unnest(range(ceil(d.demand * p.budget / p.supply)::BIGINT)) AS epoch) e),
    hit AS (SELECT e.*, s.t0, s.t1, s.s0, s.s1, e.x - (s.d1 - s.area) AS rest FROM each e JOIN seg s ON s.source IS NOT DISTINCT FROM e.source AND e.x < s.d1 AND e.x >= s.d1 - s.area WHERE e.x < e.demand)
    SELECT doc_id, source, epoch::INTEGER AS epoch, n_tokens, round(t0 + least(t1 - t0, CASE WHEN s0 + sqrt(greatest(s0 * s0 + 2 * (s1 - s0) / (t1 - t0) * greatest(rest, 0), 0)) > 0
      THEN 2 * greatest(rest, 0) / (s0 + sqrt(greatest(s0 * s0 + 2 * (s1 - s0) / (t1 - t0) * greatest(rest, 0), 0))) ELSE 0 END), 6) AS position FROM hit
    """
