"""Linear-chain conditional random field: tag-observation, tag bias and tag-tag weights; batch likelihood of all sequences, Viterbi."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that are worked on at once; a longer sequence is worked on whole.
PACK_TOKENS = 150_000
#: Weights up to which every task's gradient goes to the driver; beyond, tasks' gradients are added up by ranges of features first.
SMALL = 50_000


class CRF:
    def __init__(self, tags: list[str], size: int):
        self.tags, self.size = list(tags), size
        self.obs, self.bias, self.trans = np.zeros((size, len(tags))), np.zeros(len(tags)), np.zeros((len(tags), len(tags)))

    def scores(self, seq: list[list[int]]) -> np.ndarray:
        """(tokens, tags) sums of the weights of each token's active features; unknown features drop out."""
        out = np.tile(self.bias, (len(seq), 1))
        for i, f in enumerate(seq):
            known = [x for x in f if 0 <= x < self.size]
            if known:
                out[i] += self.obs[known].sum(0)
        return out

    def decode(self, seq: list[list[int]]) -> list[tuple[str, float]]:
        """Best tags, each with the sigmoid of its own score without the bias as confidence."""
        counts = np.array([len(f) for f in seq], np.int64)
        best, confidence = self.decode_all(np.array([len(seq)]), counts, np.array([x for f in seq for x in f], np.int64))
        return [(self.tags[t], float(c)) for t, c in zip(best, confidence)]

    def decode_all(self, lengths: np.ndarray, counts: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tags' numbers and confidences of many sequences, one after another: their lengths, the tokens' numbers of features, the features."""
        ids = np.unique(feats)
        ids = ids[(ids >= 0) & (ids < self.size)]
        lay = Layout(lengths)
        own = _sums(*_known(lay, counts, feats, ids), self.obs[ids], lay.total)
        s = own + self.bias
        best, back = s.copy(), np.zeros(s.shape, np.int16)
        for a, b, before in lay.steps():
            x = best[before, :, None] + self.trans
            back[a:b] = x.argmax(1)
            best[a:b] = s[a:b] + x.max(1)
        tag = best.argmax(1)  # right for the last token of each sequence
        for a, b, before in reversed(list(lay.steps())):
            tag[before] = back[np.arange(a, b), tag[a:b]]
        confidence = 1 / (1 + np.exp(-own[np.arange(lay.total), tag]))
        return tag[lay.place], confidence[lay.place]


class Layout:
    """Where tokens of sequences lie when all first ones come first, then all second ones and so on, the longest sequences' before the others'."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.total = int(lengths.sum())
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max(initial=0))
        # sequences that have a token at each place
        self.alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
        self.starts = np.concatenate([[0], np.cumsum(self.alive)]).astype(np.int64)
        at = np.arange(self.total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: by token in order of sequences: its place here
        self.place = self.starts[at] + np.repeat(rank, lengths)

    def steps(self) -> Iterator[tuple[int, int, slice]]:
        """From the second tokens on: where they begin and end, and where the tokens before them are."""
        for t in range(1, len(self.alive)):
            a = int(self.starts[t])
            n = int(self.alive[t])
            yield a, a + n, slice(int(self.starts[t - 1]), int(self.starts[t - 1]) + n)


def _known(lay: Layout, counts: np.ndarray, feats: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, place in ``ids``) of each feature that is among the sorted ``ids``."""
    token = np.repeat(lay.place, counts)
    if not len(ids):
        return token[:0], token[:0]
    at = np.minimum(np.searchsorted(ids, feats), len(ids) - 1)
    there = ids[at] == feats
    return token[there], at[there]


def _sums(token: np.ndarray, feat: np.ndarray, weights: np.ndarray, total: int) -> np.ndarray:
    return np.stack([np.bincount(token, weights[:, j][feat], total) for j in range(weights.shape[1])], 1) if len(token) else np.zeros((total, weights.shape[1]))


class Pack:
    """Sequences of one task, ready for gradients: features are numbered by their place in ``ids``, the known ones that occur here."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, feats: np.ndarray, gold: np.ndarray, size: int, tags: int):
        lay = Layout(lengths)
        ids = np.unique(feats)
        self.ids = ids[(ids >= 0) & (ids < size)]
        token, feat = _known(lay, counts, feats, self.ids)
        self.token, self.feat = token.astype(np.int32), feat.astype(np.int32)
        self.total, self.tags = lay.total, tags
        self.steps = list(lay.steps())
        self.gold = np.empty(lay.total, np.int16)
        self.gold[lay.place] = gold
        self.pairs = np.zeros((tags, tags))
        for a, b, before in self.steps:
            np.add.at(self.pairs, (self.gold[before], self.gold[a:b]), 1)

    def gradient(self, obs: np.ndarray, bias: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The log likelihood and its gradients; ``obs`` and its gradient are those of ``ids``. Probabilities are scaled at each token."""
        s = _sums(self.token, self.feat, obs, self.total) + bias
        top, high = s.max(1), trans.max()
        e, move = np.exp(s - top[:, None]), np.exp(trans - high)
        a, z = e.copy(), np.empty(self.total)
        first = self.steps[0][0] if self.steps else self.total
        z[:first] = a[:first].sum(1)
        a[:first] /= z[:first, None]
        for i, j, before in self.steps:
            x = (a[before] @ move) * e[i:j]
            z[i:j] = np.maximum(x.sum(1), 1e-300)
            a[i:j] = x / z[i:j, None]
        b, scaled = np.ones_like(a), e / z[:, None]
        both = np.zeros_like(trans)
        for i, j, before in reversed(self.steps):
            x = scaled[i:j] * b[i:j]
            b[before] = x @ move.T
            both += a[before].T @ x
        every = np.arange(self.total)
        value = s[every, self.gold].sum() + (self.pairs * trans).sum() - np.log(z).sum() - top.sum() - high * (self.total - first)
        delta = -(a * b)
        delta[every, self.gold] += 1
        part = np.stack([np.bincount(self.feat, delta[:, j][self.token], len(self.ids)) for j in range(self.tags)], 1) if len(self.feat) else np.zeros((len(self.ids), self.tags))
        return float(value), part, delta.sum(0), self.pairs - move * both


def _chunks(batch: pa.RecordBatch, number: dict[str, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Lengths, features a token, features and tags of an Arrow batch's sequences, about ``PACK_TOKENS`` tokens at once."""
    lengths = batch.column("tags").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    while begin < len(lengths):
        reach = np.cumsum(lengths[begin:])
        n = max(1, int(np.searchsorted(reach, PACK_TOKENS, "right")))
        some = batch.slice(begin, n)
        inner = some.column("features").flatten()
        gold = some.column("tags").flatten().dictionary_encode()
        names = np.array([number[t] for t in gold.dictionary.to_pylist()], np.int64)
        yield lengths[begin : begin + n], inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64), names[gold.indices.to_numpy(zero_copy_only=False)] if len(names) else names
        begin += n


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, least: float = 1e-3, tol: float = 1e-8, memory: int = 6) -> np.ndarray:
    """L-BFGS with halved steps for a convex function; ends where no part of the gradient exceeds ``least`` or the value falls by less than ``tol`` of the first one."""
    value, g = f(x)
    enough = tol * abs(value)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max(initial=0) < least:
            break
        d = -g
        alphas = []
        for s, y, r in reversed(pairs):
            alphas.append(a := r * float(s @ d))
            d = d - a * y
        if pairs:
            s, y, r = pairs[-1]
            d *= 1 / (r * float(y @ y))
        else:
            d /= max(1.0, float(np.linalg.norm(g)))
        for (s, y, r), a in zip(pairs, reversed(alphas)):
            d += (a - r * float(y @ d)) * s
        slope, step = float(g @ d), 1.0
        while True:
            new, gn = f(x + step * d)
            if np.isfinite(new) and new <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        s, y = step * d, gn - g
        if (sy := float(s @ y)) > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / sy)]
        fell, x, value, g = value - new, x + s, new, gn
        if fell <= enough:
            break
    return x


def train(sequences: DataFrame, size: int, tags: list[str], rounds: int = 100, ridge: float = 1e-3) -> CRF:
    """From ``(doc_id, features array<array<int>>, tags array<string>)``: fitted to the likelihood of all sequences; each round's gradient is one job over all tasks."""
    spark, k = sequences.sparkSession, len(tags)
    sc, number = spark.sparkContext, {t: i for i, t in enumerate(tags)}

    def pack(batches):
        for batch in batches:
            for chunk in _chunks(batch, number):
                if len(chunk[3]):
                    yield pa.RecordBatch.from_pylist([{"pack": pickle.dumps(Pack(*chunk, size, k))}], pa.schema([("pack", pa.binary())]))

    parts = max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packs = sequences.select("doc_id", "features", "tags").repartition(parts, "doc_id").mapInArrow(pack, "pack binary").rdd.map(lambda r: bytes(r.pack)).persist(StorageLevel.DISK_ONLY)
    ends = (size * k, size * k + k)
    dense = ends[1] <= SMALL
    block = max(1, 500_000 // k)
    blocks = size // block + 1

    def gradients(shared):
        def run(held):
            obs, bias, trans = shared.value
            value, gb, gt, ids, parts = 0.0, np.zeros(k), np.zeros((k, k)), [], []
            for p in map(pickle.loads, held):
                v, g, b, t = p.gradient(obs[p.ids], bias, trans)
                value, gb, gt = value + v, gb + b, gt + t
                ids.append(p.ids)
                parts.append(g)
            if not ids:
                return
            yield -1, (value, gb, gt)
            every, total = ids[0], parts[0]
            if len(ids) > 1:
                every, at = np.unique(np.concatenate(ids), return_inverse=True)
                rows = np.concatenate(parts)
                total = np.stack([np.bincount(at, rows[:, j], len(every)) for j in range(k)], 1)
            cuts = np.searchsorted(every, np.arange(blocks + 1) * block)
            for n in range(blocks):
                if cuts[n] < cuts[n + 1]:
                    yield n, (every[cuts[n] : cuts[n + 1]], total[cuts[n] : cuts[n + 1]])

        return run

    def added(rows):
        sums: dict[int, np.ndarray] = {}
        for n, part in rows:
            if n < 0:
                yield n, part
                continue
            if n not in sums:
                sums[n] = np.zeros((min(block, size - n * block), k))
            sums[n][part[0] - n * block] += part[1]
        for n, total in sums.items():
            yield n, (None, total.astype(np.float32))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        obs, bias, trans = x[: ends[0]].reshape(size, k), x[ends[0] : ends[1]], x[ends[1] :].reshape(k, k)
        shared = sc.broadcast((obs, bias, trans))
        rows = packs.mapPartitions(gradients(shared))
        rows = (rows if dense else rows.partitionBy(min(blocks, parts)).mapPartitions(added)).collect()
        shared.destroy()
        total, g = 0.0, -ridge * x
        go, gb, gt = g[: ends[0]].reshape(size, k), g[ends[0] : ends[1]], g[ends[1] :].reshape(k, k)
        for n, part in rows:
            if n < 0:
                total += part[0]
                gb += part[1]
                gt += part[2]
            elif part[0] is None:
                go[n * block : n * block + len(part[1])] += part[1]
            else:
                go[part[0]] += part[1]
        return ridge * float(x @ x) / 2 - total, -g

    x = minimize(value, np.zeros(ends[1] + k * k), rounds)
    packs.unpersist()
    m = CRF(tags, size)
    m.obs, m.bias, m.trans = x[: ends[0]].reshape(size, k).copy(), x[ends[0] : ends[1]].copy(), x[ends[1] :].reshape(k, k).copy()
    return m


def decode(df: DataFrame, features: Column, model: CRF) -> Column:
    """``array<struct<tag, confidence>>`` by Viterbi in an Arrow UDF with the weights broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<tag: string, confidence: double>>")
    def viterbi(v: pa.Array) -> pa.Array:
        model = shared.value
        lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tags, confidences, begin = [np.zeros(0, np.int64)], [np.zeros(0)], 0
        while begin < len(lengths):
            n = max(1, int(np.searchsorted(np.cumsum(lengths[begin:]), PACK_TOKENS, "right")))
            inner = v.slice(begin, n).flatten()
            t, c = model.decode_all(lengths[begin : begin + n], inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            tags.append(t)
            confidences.append(c)
            begin += n
        named = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(tags).astype(np.int32)), pa.array(model.tags, pa.string())).cast(pa.string())
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([named, pa.array(np.concatenate(confidences))], ["tag", "confidence"]))

    return viterbi.asNondeterministic()(features)
