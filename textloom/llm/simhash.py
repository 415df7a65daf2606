"""Near-duplicate groups: SimHash fingerprints, random bit-sampling hashing, verified distances.

Each document's set of distinct words gives a 128-bit SimHash. Several hash tables each group the distinct
fingerprints by coordinates sampled at random: as many as leave about ``BUCKET`` in a bucket, so they grow with the logarithm of
the corpus, and as many tables as then find a pair at the limit with probability ``RECALL``. Inside a bucket all pairs
are compared, block by block, and only a forest that connects the near ones leaves it. A bucket of over ``bucket_cap``
fingerprints goes to the next round, where ``EXTRA_TABLES`` splits by additional coordinates spread it over other tasks,
again until none is oversized. Only verified pairs, at most ``max_distance`` bits apart, count; their connected components are the groups.

Dense families, in which additional bits would thin out nothing, are contracted before they are split. Around a pivot, points
within ``delta`` bits can have partners only within ``max_distance + delta`` of it: those within ``max_distance`` are linked to the
pivot itself, the few between are compared with the inner points one by one. After that the inner points have no link left to lose and
go. This is done once for families of a notable share of the corpus, in map-only passes against a bounded set of pivots,
and again inside oversized buckets.

Cost at scale: one shuffle of a short row (24 bytes) a table and distinct fingerprint, one of fingerprints, and
edges, at most one for each point of a bucket. Documents with equal fingerprints are one point in all of this. Texts move only
where the caller filters documents and the ids to drop are too many to broadcast, then once and by id.

Defined results: null, empty or wordless texts have no fingerprint and are never grouped, nor dropped. Rows that repeat an id
or a text fall in one group. Null ids are allowed: they are the last to be kept. Ties go to the smallest id, of equal ids to the smallest
text hash. Texts count whole whatever their length. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, col, discard, forget, fresh, materialize, mix64, scan, written

#: Fingerprints that sampled bits leave in a bucket on average, size from which one is split, chance to try a pair at the limit.
MAX_DISTANCE, BUCKET, BUCKET_CAP, RECALL = 24, 256, 4096, 0.92
#: Additional bits of each split of an oversized bucket, and number of such splits: a pair at 24 of 128 bits is tried in 0.97 of cases.
EXTRA_BITS, EXTRA_TABLES = 6, 11
#: Points tried as pivots of corpus-wide families, and bound on the points between that a pivot may have.
PIVOTS, BETWEEN = 512, 4096
#: Points of an oversized bucket that a task holds to contract it (16 bytes each); a larger one is split first.
HELD = 4_000_000
_FP = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of 64 bits, and which texts have a fingerprint. Bit b is set where over half the distinct words' hashes set it."""
    out = np.zeros((len(texts), 2), np.uint64)
    has = np.zeros(len(texts), bool)
    for first, some in chunks(texts):
        h, doc, _, _ = scan(some)
        if not len(h):
            continue
        key = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        doc, h = (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        ends = np.append(starts[1:], len(doc))
        for d, s, e in zip(doc[starts].tolist(), starts.tolist(), ends.tolist()):
            total = np.zeros(128, np.int64)
            for a in range(s, e, 8160):
                x = h[a : min(a + 8160, e)]
                both = np.stack([mix64(x + np.uint64(1)), mix64(x + np.uint64(0x9E3779B97F4A7C15))], 1)
                bits = np.unpackbits(both.view(np.uint8), axis=1).view(np.uint64)  # bytes of 0 and 1, eight to a lane
                for i in range(0, len(x), 255):
                    total += bits[i : i + 255].sum(0).view(np.uint8)
            out[first + d] = np.packbits(2 * total > e - s).view(np.uint64)
            has[first + d] = True
    return out, has


def fingerprint(text: Column) -> Column:
    """struct<hi, lo> or null, as an Arrow UDF; evaluated once however often the plan refers to it."""

    @F.arrow_udf("struct<hi: long, lo: long>")
    def simhash(v: pa.Array) -> pa.Array:
        fp, has = fingerprints(v.to_pylist())
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in (0, 1)], fields=list(_FP), mask=pa.array(~has))

    return simhash.asNondeterministic()(text)


def _samples(seed: int, tables: int, bits: int) -> np.ndarray:
    return np.stack([np.random.default_rng([seed, t]).choice(128, bits, replace=False) for t in range(tables)])


def _keys(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sampled coordinates of each fingerprint as one number."""
    key = np.zeros(len(fp), np.int64)
    for b in at.tolist():
        key = (key << 1) | ((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64)
    return key


def tables_for(bits: int, distance: int = MAX_DISTANCE, recall: float = RECALL) -> int:
    """Tables of so many bits that group a pair at the distance at least once with the given probability."""
    hit = comb(128 - distance, bits) / comb(128, bits)
    return 1 if hit >= recall else ceil(log(1 - recall) / log(1 - hit))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) numbers of differing bits."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    out += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    return out


def _join(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The forest ``root`` (each point's smallest connected point) with further edges."""
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _connect(fp: np.ndarray, d: int, root: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """``root`` joined by all near pairs among ``fp[mine]``; by blocks, so memory is bounded however many pairs there are."""
    some = fp[mine]
    n, step = len(some), max(1, 2_000_000 // max(1, len(some)))
    for i in range(0, n - 1, step):
        a, b = np.nonzero(_distances(some[i : i + step], some[i:]) <= d)
        root = _join(root, mine[a[b > a] + i], mine[b[b > a] + i])
    return root


def _radius(counts: np.ndarray, d: int, most: float) -> int:
    """From a pivot's histogram of distances: the largest inner radius whose inner times between points are at most ``most``; -1 for none."""
    up = np.cumsum(counts)
    best = -1
    for delta in range(0, d + 1, 2):
        if up[delta] * (up[min(d + delta, len(up) - 1)] - up[d]) <= most:
            best = delta
    return best


def _contract(fp: np.ndarray, d: int, cap: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``root`` joined around pivots, and the points that are left: at most ``cap``, or no dense family any more."""
    alive = np.arange(len(fp))
    while len(alive) > cap:
        tried = alive[np.unique(np.linspace(0, len(alive) - 1, 16).astype(np.int64))]
        best = (0, 0, 0)
        for k in tried.tolist():
            counts = np.bincount(_distances(fp[k : k + 1], fp[alive])[0], minlength=129)
            delta = _radius(counts, d, 64.0 * len(alive))
            if delta >= 0:
                best = max(best, (int(counts[: delta + 1].sum()), k, delta))
        inner, k, delta = best
        if inner < len(alive) / 50:
            break
        dist = _distances(fp[k : k + 1], fp[alive])[0]
        near = alive[dist <= d]
        root = _join(root, np.full(len(near), k), near)
        inside, between = alive[dist <= delta], alive[(dist > d) & (dist <= d + delta)]
        for i in range(0, len(between), max(1, 2_000_000 // len(inside))):
            some = between[i : i + max(1, 2_000_000 // len(inside))]
            hit = _distances(fp[some], fp[inside]) <= d
            found = hit.any(1)
            root = _join(root, some[found], inside[hit.argmax(1)[found]])
        alive = alive[dist > delta]
    return root, alive


def _bucket(fp: np.ndarray, d: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's forest, and the points that further splits have to connect."""
    root = np.arange(len(fp))
    root, alive = _contract(fp, d, cap, root)
    if len(alive) > cap:
        return root, alive
    return _connect(fp, d, root, alive), alive[:0]


_EDGE = pa.schema([(c, pa.int64()) for c in ("a_hi", "a_lo", "b_hi", "b_lo", "bucket")])
_EDGE_DDL = "a_hi long, a_lo long, b_hi long, b_lo long, bucket long"


def _words(b: pa.RecordBatch) -> np.ndarray:
    """Columns hi and lo as (n, 2) words of 64 bits."""
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("hi", "lo")], 1).view(np.uint64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    return batch(_EDGE, a[:, 0].copy(), a[:, 1].copy(), b[:, 0].copy(), b[:, 1].copy(), pa.nulls(len(a), pa.int64()))


def families(points: DataFrame, n: int, max_distance: int, cap: int) -> tuple[DataFrame, DataFrame] | None:
    """Edges around corpus-wide pivots and the points that are left, or None where no family is that large.

    At most ``PIVOTS`` points and ``BETWEEN`` for each pivot come to the driver. Everything else is map-only, but for the
    pivots' histograms of distances, at most ``PIVOTS`` times ``2 * max_distance`` rows a task.
    """
    d, far = max_distance, 2 * max_distance
    tried = points.select("hi", "lo").orderBy(F.xxhash64("hi", "lo"), "hi", "lo").limit(PIVOTS).collect()
    pivots = np.array([tuple(r) for r in tried], np.int64).reshape(-1, 2).view(np.uint64)
    kept = pa.schema([("pivot", pa.int32()), ("distance", pa.int32()), ("n", pa.int64())])

    def histogram(batches):
        total = np.zeros((len(pivots), far + 1), np.int64)
        for b in batches:
            fp = _words(b)
            for i in range(0, len(fp), 4096):
                dist = _distances(pivots, fp[i : i + 4096])
                p, q = np.nonzero(dist <= far)
                np.add.at(total, (p, dist[p, q]), 1)
        p, x = np.nonzero(total)
        yield batch(kept, p.astype(np.int32), x.astype(np.int32), total[p, x])

    counts = np.zeros((len(pivots), far + 1), np.int64)
    for r in points.select("hi", "lo").mapInArrow(histogram, "pivot int, distance int, n long").groupBy("pivot", "distance").agg(F.sum("n").alias("n")).collect():
        counts[r.pivot, r.distance] = r.n
    up = np.cumsum(counts, 1)
    chosen: list[tuple[int, int]] = []
    radius = [max((x for x in range(0, d + 1, 2) if up[k, min(d + x, far)] - up[k, d] <= BETWEEN), default=-1) for k in range(len(pivots))]
    inner = [int(up[k, x]) if x >= 0 else 0 for k, x in enumerate(radius)]
    for k in sorted(range(len(pivots)), key=lambda k: (-inner[k], k)):
        if inner[k] <= max(cap, n // 256):
            break
        if all(_distances(pivots[k : k + 1], pivots[j : j + 1])[0, 0] > x for j, x in chosen):
            chosen.append((k, radius[k]))
    if not chosen:
        return None
    centre, delta = pivots[[k for k, _ in chosen]], np.array([x for _, x in chosen])

    def between(batches):
        for b in batches:
            fp = _words(b)
            dist = _distances(centre, fp)
            p, q = np.nonzero((dist > d) & (dist <= d + delta[:, None]))
            yield batch(pa.schema([("pivot", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())]), p.astype(np.int32), fp[q, 0].view(np.int64), fp[q, 1].view(np.int64))

    held: dict[int, list] = {}
    for r in points.select("hi", "lo").mapInArrow(between, "pivot int, hi long, lo long").collect():
        held.setdefault(r.pivot, []).append((r.hi, r.lo))
    rim = {k: np.array(sorted(v), np.int64).view(np.uint64) for k, v in held.items()}

    def link(batches):
        for b in batches:
            fp = _words(b)
            dist = _distances(centre, fp)
            for k in range(len(centre)):
                near = fp[(dist[k] <= d) & (dist[k] > 0)]
                yield _edges(np.repeat(centre[k : k + 1], len(near), 0), near)
                inside, ring = fp[dist[k] <= delta[k]], rim.get(k)
                if ring is not None and len(inside):
                    for i in range(0, len(ring), 512):
                        hit = _distances(ring[i : i + 512], inside) <= d
                        found = hit.any(1)
                        # all inner points are connected by the pivot: one edge is as good as all
                        yield _edges(ring[i : i + 512][found], inside[hit.argmax(1)[found]])
            left = fp[(dist > delta[:, None]).all(0)].view(np.int64)
            none = pa.nulls(len(left), pa.int64())
            yield batch(_EDGE, left[:, 0].copy(), left[:, 1].copy(), none, none, np.zeros(len(left), np.int64))

    out = materialize(points.select("hi", "lo").mapInArrow(link, _EDGE_DDL), "families")
    return out.where("bucket is null").drop("bucket"), out.where("bucket is not null").select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"))


def edges(points: DataFrame, max_distance: int = MAX_DISTANCE, tables: int | None = None, bits: int | None = None, bucket_cap: int = BUCKET_CAP, seed: int = 17) -> DataFrame:
    """From distinct ``(hi, lo)`` to edges ``(a_hi, a_lo, b_hi, b_lo)`` that span the near pairs of every bucket."""
    n = points.count()
    out = None
    if found := families(points, n, max_distance, bucket_cap):
        out, points = found
    bits = bits or max(4, min(40, round(log2(max(1, n) / BUCKET)) if n else 4))
    tables = tables or tables_for(bits, max_distance)
    keyed = pa.schema([("bucket", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(samples: np.ndarray):
        def run(batches):
            for b in batches:
                fp = _words(b)
                own = b.column(b.schema.get_field_index("bucket")).to_numpy().view(np.uint64)
                # other buckets split by other coordinates, so that a pair that one table's splits miss has its chance in the next table's
                which = own % np.uint64(len(samples))
                for g in np.unique(which).tolist():
                    mine, bucket = fp[which == g], own[which == g]
                    hi, lo = mine[:, 0].view(np.int64), mine[:, 1].view(np.int64)
                    for t, at in enumerate(samples[g]):
                        key = mix64(bucket * np.uint64(0x9E3779B97F4A7C15) + mix64((np.uint64(t + 1) << np.uint64(48)) | _keys(mine, at).astype(np.uint64)))
                        yield batch(keyed, key.view(np.int64), hi, lo)

        return run

    def search(batches):
        def close(rows: np.ndarray, bucket: int):
            # in order, so that tables that find the same group give the same edges
            fp = np.ascontiguousarray(rows[np.lexsort((rows[:, 1].view(np.int64), rows[:, 0].view(np.int64)))])
            root, left = _bucket(fp, max_distance, bucket_cap)
            j = np.flatnonzero(root != np.arange(len(fp)))
            if len(j):
                yield _edges(fp[root[j]], fp[j])
            if len(left):
                yield again(fp[left], bucket)

        def again(fp: np.ndarray, bucket: int) -> pa.RecordBatch:
            fp, none = fp.view(np.int64), pa.nulls(len(fp), pa.int64())
            return batch(_EDGE, fp[:, 0].copy(), fp[:, 1].copy(), none, none, np.full(len(fp), bucket))

        held: list[np.ndarray] = []
        size, current, over = 0, None, False
        for b in batches:
            bucket = b.column(0).to_numpy()
            fp = _words(b)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if s == e:
                    continue
                if bucket[s] != current:
                    if size > 1:
                        yield from close(np.concatenate(held), current)
                    held, size, current, over = [], 0, int(bucket[s]), False
                if over:
                    yield again(fp[s:e], current)
                    continue
                held.append(fp[s:e])
                size += e - s
                if size > HELD:
                    yield from (again(x, current) for x in held)
                    held, size, over = [], 0, True
        if size > 1:
            yield from close(np.concatenate(held), current)

    rows, samples, depth = points.select("hi", "lo", F.lit(0).cast("long").alias("bucket")), _samples(seed, tables, bits)[None], 0
    while True:
        keys = rows.mapInArrow(spread(samples), "bucket long, hi long, lo long")
        found = materialize(keys.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(search, _EDGE_DDL), "pairs")
        some = found.where("bucket is null").drop("bucket")
        out = some if out is None else out.unionByName(some)
        rows = found.where("bucket is not null").select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), "bucket")
        if rows.isEmpty():
            return out
        depth += 1
        samples = np.stack([_samples(seed + 100 * depth + g, EXTRA_TABLES, EXTRA_BITS) for g in range(16)])


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``: alternating large and small stars, each round a written table.

    Ends when no edge changes; the rounds grow with the logarithm of the longest chain. Nodes may be of any type that has an order.
    Least neighbours are aggregated before they are joined, so a node of very many edges is combined on the map side and
    its edges are split by the adaptive skew join.
    """
    pairs = materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, pairs = pairs, materialize(small.where("u <> v").distinct(), "edges")
        discard(before)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state


def _roots(points: DataFrame, **how) -> DataFrame:
    """``(fp, root)`` of the fingerprints that have a near partner."""
    e = edges(points, **how)
    return components(e.select(F.struct(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).alias("a"), F.struct(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo")).alias("b")))


def _groups(slim: DataFrame, **how) -> DataFrame:
    """``(fp, best, group_size)`` of the fingerprints in groups of two or more rows of ``(id, h, fp)``; copies are counted on the map side first."""
    points = slim.select("fp.hi", "fp.lo").distinct()
    roots = _roots(points, **how)
    best = slim.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("best"), F.count("*").alias("n"))
    best = best.join(roots, F.col("fp") == roots.node, "left").select("fp", "best", "n", F.coalesce("root", "fp").alias("root"))
    of = best.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("group_size")).where("group_size > 1")
    return best.select("fp", "root").join(of, "root").select("fp", "best", "group_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(doc_id, group_id, group_size)`` of all documents that are in a group of two or more.

    ``group_id`` is the smallest id of the group. ``how``: parameters of ``edges``.
    """
    slim = docs.select(col(id_col).alias("id"), F.lit(0).alias("h"), fingerprint(col(text_col)).alias("fp")).where("fp is not null")
    slim = materialize(slim, "simhash")
    return slim.join(_groups(slim, **how), "fp").select(F.col("id").alias("doc_id"), F.col("best.id").alias("group_id"), "group_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with all their columns, one of each group: that of the smallest id, of equal ids the smallest text hash.

    Fingerprints are made once. What goes is a table of ids and text hashes; documents are held against it by both, so copies of one text don't meet in one task.
    """
    id_key, hash_key = fresh(docs, "id_key", "hash_key")
    before = written()
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    slim = materialize(docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h"), fingerprint(col(text_col)).alias("fp")).where("fp is not null"), "simhash")
    members = slim.join(_groups(slim, **how), "fp")
    lost = members.where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))))
    losers = materialize(lost.select(name(F.col("id")).alias("lost_id"), F.col("h").alias("lost_hash")).distinct(), "losers")
    twins = materialize(slim.groupBy(name(F.col("id")).alias("lost_id"), F.col("h").alias("lost_hash")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twins")
    forget(before, losers, twins)
    marked = docs.withColumns({id_key: name(col(id_col)), hash_key: F.xxhash64(col(text_col))})
    same = lambda t: (col(id_key) == t.lost_id) & (col(hash_key) == t.lost_hash)
    out = marked.join(losers, same(losers), "left_anti")
    if not twins.isEmpty():
        # rows that agree in id and text: one of each stays
        out = out.join(twins, same(twins), "left_anti").unionByName(out.join(twins, same(twins), "left_semi").dropDuplicates([id_key, hash_key]))
    return out.drop(id_key, hash_key)
