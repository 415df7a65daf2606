"""Substring dedup by recompression: passages of at least ``min_words`` words that stand in two or more documents.

Rounds of recompression parse every document's words. A round names each run of one symbol after the symbol and the run's
length, then, with a fresh split of all symbols into left and right ones by a keyed hash, names each adjacent left-right
pair after its two symbols. Names are 64-bit hashes of what they stand for, so they are global: all workers name
equal content equally without exchanging tables, and rounds need no shuffle between them. In the first rounds symbols of over
``longest`` words rest, in further ones symbols of over ``longest_high``. Inside equal passages the parse is therefore the
same but for a few symbols at either end. Low symbols that occur in two documents reveal where repeats can be; high
symbols, of twice ``min_words`` words or more, that do are repeats, verified by their names.

Stages: (1) one pass names low and high symbols; they are shuffled by name, and those in one document only go. (2) The rest
go back to their documents, by key, as stretches of shared low symbols, short ones left out, and as verified high ones; there every
window of ``min_words`` words whose middle lies in a stretch is hashed, but for those inside a verified symbol that an earlier document
(by key) holds too: that one, or one before it, stands for all. (3) Windows are shuffled
by hash; those that occur in two documents are verified repeats. (4) All are merged per document to longest spans. Rows are read
in hash order as a stream, so a symbol or window that occurs everywhere needs no memory.

Defined results: null or empty texts and texts under ``min_words`` words have no spans, an empty table has none. Texts count whole
whatever their length. Rows that agree in id and text are one document; rows that differ in either are two. Null ids are allowed. A passage
that repeats only inside one document isn't reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, col, list_of, materialize, mix64, ranges, scan

MIN_WORDS, ROUNDS, LONGEST = 50, 12, 4
#: Limits, and rounds at each, of the high symbols.
HIGH = ((100, 6), (400, 5))
#: Of the filter on documents: bits a key, and most bits altogether (64 MB).
FILTER_BITS, MOST_BITS = 8, 1 << 29
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix64(mix64(a + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93) + b)


class Parse:
    """Symbols of words as (name, index of first word, words, document), a round at a time."""

    def __init__(self, h: np.ndarray, doc: np.ndarray):
        self.sym, self.at, self.size, self.doc = h.copy(), np.arange(len(h)), np.ones(len(h), np.int64), doc.copy()
        self.round = 0

    def rounds(self, n: int, longest: int) -> "Parse":
        """``n`` further rounds in which symbols of over ``longest`` words rest."""
        for _ in range(n):
            r, self.round = self.round, self.round + 1
            if len(self.sym) < 2:
                continue
            sym, at, size, doc = self.sym, self.at, self.size, self.doc
            awake = size <= longest
            # runs of one awake symbol
            same = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1]) & awake[1:]
            if same.any():
                head = np.flatnonzero(np.concatenate([[True], ~same]))
                count = np.diff(np.append(head, len(sym)))
                many = count > 1
                new = sym[head]
                new[many] = _name(new[many], count[many].astype(np.uint64), 77)
                sym, at, size, doc = new, at[head], np.add.reduceat(size, head), doc[head]
                awake = size <= longest
            # left symbol before right symbol
            left = (mix64(sym + np.uint64(0xA0761D6478BD642F + r)) & np.uint64(1)).astype(bool)
            pair = left[:-1] & ~left[1:] & awake[:-1] & awake[1:] & (doc[1:] == doc[:-1])
            first = np.flatnonzero(pair)
            if len(first):
                sym[first] = _name(sym[first], sym[first + 1], 101)
                size[first] += size[first + 1]
                keep = np.ones(len(sym), bool)
                keep[first + 1] = False
                sym, at, size, doc = sym[keep], at[keep], size[keep], doc[keep]
            self.sym, self.at, self.size, self.doc = sym, at, size, doc
        return self


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]))
    return _POWERS[0]


def window_hashes(h: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``h[s : s + width]`` for each s, position-free."""
    power = _powers(width)
    total = np.zeros(len(start), np.uint64)
    for k in range(width):
        total += h[start + k] * power[k]
    return mix64(total)


def shared_rows(batches, mark: bool = False):
    """Of rows (hash, document, ...) in the order of both, those whose hash has two different documents; without the hash.

    ``mark`` adds a column that tells whether the document is the hash's first. Only rows of a hash's first document are held back, until a second document or another hash shows.
    """
    last, last_doc, first_doc, two, waiting = None, None, None, False, []
    for b in batches:
        if not b.num_rows:
            continue
        h, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        goes_on = last is not None and h[0] == last
        new = np.concatenate([[not goes_on], h[1:] != h[:-1]])
        other = np.concatenate([[goes_on and d[0] != last_doc], d[1:] != d[:-1]]) & (~new)
        group = np.cumsum(new)  # 0: goes on from the last batch
        n = int(group[-1]) + 1
        has_two = np.zeros(n, bool)
        has_two[group[other]] = True
        rest = b.select(list(range(1, b.num_columns)))
        firsts = np.zeros(n, np.int64)
        firsts[group[new]] = d[new]
        if goes_on:
            firsts[0] = first_doc
        if mark:
            rest = pa.RecordBatch.from_arrays([*rest.columns, pa.array(firsts[group] == d)], [*rest.schema.names, "first"])
        if goes_on:
            has_two[0] |= two
            if has_two[0]:
                yield from waiting
                waiting = []
            elif n > 1:
                waiting = []
        else:
            waiting = []
        out = has_two[group]
        if out.any():
            yield rest.filter(pa.array(out))
        two = bool(has_two[n - 1])
        if not two:
            waiting.append(rest.filter(pa.array(group == n - 1)))
        last, last_doc, first_doc = h[-1], d[-1], firsts[n - 1]


def among(keys: DataFrame, name: str):
    """A function from a column of hashes to whether it may be among ``keys``: a Bloom filter of ``FILTER_BITS`` bits a key and two hashes.

    The filter has at most ``MOST_BITS`` bits, whatever the number of keys, and is broadcast; beyond, it lets more pass but never loses a key.
    """
    n = keys.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, int(n * FILTER_BITS).bit_length()))
    place = lambda x: [(mix64(x.view(np.uint64) + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in (3, 5)]
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def words(batches):
        for b in batches:
            at = np.concatenate(place(b.column(0).to_numpy()))
            yield batch(schema, (at >> 6).astype(np.int32), np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))

    rows = keys.select(name).mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    held = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def may_be(v: pa.Array) -> pa.Array:
        out = np.ones(len(v), bool)
        for at in place(v.to_numpy(zero_copy_only=False)):
            out &= (held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pa.array(out)

    return may_be


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, rounds: int = ROUNDS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", high: tuple = HIGH) -> DataFrame:
    """``(doc_id, start, end, n_words)``: longest spans, in characters from 0, end exclusive, of windows of ``min_words`` words that stand in another document too; windows that overlap or touch are one span."""
    if min_words < 10 * longest + 4:
        raise ValueError("min_words is at least ten times longest and 4, else repeats needn't share a symbol")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).where("text is not null and length(text) > 0")
    base = base.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("doc"))
    # high symbols have their size below 0
    symbols = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])

    def name(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            for first, some in chunks(b.column(1).to_pylist()):
                h, doc, _, _ = scan(some)
                if not len(h):
                    continue
                words = np.bincount(doc, minlength=len(some))
                begin = np.cumsum(words) - words
                p = Parse(h, doc).rounds(rounds, longest)
                sym, at, size, d = p.sym.copy(), p.at, p.size, p.doc
                # runs carry their length in their name: long ones are found by their unit, whatever the length
                good = (words[d] >= min_words) & (size >= longest)
                long = good & (size > 4 * longest)
                if long.any():
                    sym[long] = _name(h[at[long]], np.zeros(int(long.sum()), np.uint64), 131)
                rows = [(sym[good], d[good], at[good], size[good])]
                for most, more in high:
                    before = len(p.sym)
                    p.rounds(more, most)
                    good = p.size >= 2 * min_words
                    if len(p.sym) < before and good.any():
                        rows.append((p.sym[good], p.doc[good], p.at[good], -p.size[good]))
                for sym, d, at, size in rows:
                    yield batch(symbols, sym.view(np.int64), key[first + d], (at - begin[d]).astype(np.int32), size.astype(np.int32))

    named = base.select("doc", "text").mapInArrow(name, "h long, doc long, at int, size int")
    named = named.repartition(n, "h").sortWithinPartitions("h", "doc")
    shared = named.mapInArrow(lambda batches: shared_rows(batches, True), "doc long, at int, size int, first boolean")
    least = min_words - 2 * (4 * longest + 1)  # what the ends of a repeat, at most so many words each, leave shared in its middle
    marks = shared.groupBy("doc").agg(F.collect_list("at").alias("at"), F.collect_list("size").alias("size"), F.collect_list("first").alias("first"))
    marks = marks.select(F.col("doc").alias("mark_doc"), _stretches(2 * longest, least, "at", "size", "first").alias("runs"))
    marks = materialize(marks.where("size(runs) > 0"), "marks")
    # rows that agree in all are one document; texts without marks aren't shuffled, but for the filter's few mistakes
    some = base.where(among(marks, "mark_doc")(F.col("doc")))
    found = some.join(marks, some.doc == marks.mark_doc).select("doc", "text", "runs")
    windows = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("to", pa.int32()), ("size", pa.int32())])
    half = min_words // 2

    def window(batches):
        for b in batches:
            key, runs = b.column(0).to_numpy(), b.column(2)
            for first, some in chunks(b.column(1).to_pylist()):
                h, doc, start, size = scan(some)
                words = np.bincount(doc, minlength=len(some)) if len(h) else np.zeros(len(some), np.int64)
                begin = np.cumsum(words) - words
                mine = runs.slice(first, len(some))
                d = np.repeat(np.arange(len(some)), np.array([len(x) for x in mine]))
                flat = mine.flatten()
                lo, hi, kind = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end", "kind"))
                sure = kind > 0
                s, e = begin[d[sure]] + lo[sure], begin[d[sure]] + hi[sure]
                # windows that another document stands for, by the word they begin at
                covered = np.zeros(len(h) + 1, np.int64)
                other = kind[sure] == 2
                np.add.at(covered, s[other], 1)
                np.add.at(covered, e[other] - min_words + 1, -1)
                covered = np.cumsum(covered) > 0
                if len(s):
                    yield batch(windows, mix64(s.astype(np.uint64)).view(np.int64), key[first + d[sure]], (lo[sure] << 32) | start[s], (start[e - 1] + size[e - 1]).astype(np.int32), (e - s).astype(np.int32))
                d, lo, hi = d[~sure], lo[~sure], hi[~sure]
                mid = ranges(begin[d] + lo, hi - lo)
                d = np.repeat(d, hi - lo)
                s = mid - half
                ok = (s >= begin[d]) & (s + min_words <= begin[d] + words[d])
                s, d = s[ok], d[ok]
                ok = ~covered[s]
                s, d = s[ok], d[ok]
                for i in range(0, len(s), 200_000):
                    t, e = s[i : i + 200_000], d[i : i + 200_000]
                    last = t + min_words - 1
                    yield batch(windows, window_hashes(h, t, min_words).view(np.int64), key[first + e], ((t - begin[e]) << 32) | start[t], (start[last] + size[last]).astype(np.int32), np.full(len(t), min_words, np.int32))

    def verified(batches):
        sure: list[pa.RecordBatch] = []

        def to_compare():
            for b in batches:
                known = b.column(4).to_numpy() != min_words
                if known.any():
                    sure.append(b.filter(pa.array(known)).select([1, 2, 3, 4]))
                    b = b.filter(pa.array(~known))
                yield b

        for b in shared_rows(to_compare()):
            yield from sure
            sure.clear()
            yield b
        yield from sure

    rows = found.mapInArrow(window, "h long, doc long, place long, to int, size int")
    rows = rows.repartition(n, "h").sortWithinPartitions("h", "doc")
    twice = rows.mapInArrow(verified, "doc long, place long, to int, size int")
    spans = twice.groupBy("doc").agg(F.collect_list("place").alias("places"), F.collect_list("to").alias("tos"), F.collect_list("size").alias("sizes"))
    spans = spans.select("doc", F.explode(_merge("places", "tos", "sizes")).alias("s"))
    ids = base.select("doc", "doc_id").distinct()
    return spans.join(ids, "doc").select("doc_id", "s.start", "s.end", "s.n_words")


def _stretches(gap: int, least: int, *columns: str):
    """Kind 0: words of shared low symbols, and of under ``gap`` words between them, as stretches of at least ``least`` words. High symbols as they are, of kind 1 in their first document and 2 in others."""

    @F.arrow_udf("array<struct<start: int, end: int, kind: tinyint>>")
    def stretches(at: pa.Array, size: pa.Array, first: pa.Array) -> pa.Array:
        counts, parts = [], ([], [], [])
        for i in range(len(at)):
            a, z = at[i].values.to_numpy().astype(np.int64), size[i].values.to_numpy().astype(np.int64)
            high = z < 0
            held = [(a[high], (a - z)[high], 2 - first[i].values.to_numpy(zero_copy_only=False)[high])]
            a, z = a[~high], z[~high]
            if len(a):
                order = np.argsort(a, kind="stable")
                a = a[order]
                reach = np.maximum.accumulate(a + z[order])
                cut = np.flatnonzero(a[1:] - reach[:-1] >= gap) + 1
                s, e = a[np.append(0, cut)], reach[np.append(cut - 1, len(a) - 1)]
                long = e - s >= least
                held.append((s[long], e[long], np.zeros(int(long.sum()), np.int64)))
            counts.append(sum(len(x[0]) for x in held))
            for x in held:
                for part, v in zip(parts, x):
                    part.append(v)
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in zip(parts, (pa.int32(), pa.int32(), pa.int8()))]
        return list_of(np.array(counts, np.int64), pa.StructArray.from_arrays(flat, ["start", "end", "kind"]))

    return stretches(*columns)


def _merge(*columns: str):
    """Spans as (first word and character, last character, words) to longest ones in characters."""

    @F.arrow_udf("array<struct<start: int, end: int, n_words: int>>")
    def merge(places: pa.Array, tos: pa.Array, sizes: pa.Array) -> pa.Array:
        counts, parts = [], ([], [], [])
        for i in range(len(places)):
            p, to, size = (x[i].values.to_numpy() for x in (places, tos, sizes))
            order = np.argsort(p, kind="stable")
            p = p[order]
            word, start = p >> 32, p & 0xFFFFFFFF
            reach, to = np.maximum.accumulate(word + size[order]), np.maximum.accumulate(to[order])
            cut = np.flatnonzero(word[1:] > reach[:-1]) + 1
            first, last = np.append(0, cut), np.append(cut - 1, len(p) - 1)
            counts.append(len(first))
            for held, v in zip(parts, (start[first], to[last], reach[last] - word[first])):
                held.append(v)
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32()) for x in parts]
        return list_of(np.array(counts, np.int64), pa.StructArray.from_arrays(flat, ["start", "end", "n_words"]))

    return merge(*columns)
