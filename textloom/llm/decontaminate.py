"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's phrases.

A phrase is a window of ``phrase_words`` words of a benchmark item (an item that is shorter, but has ``least_words``,
is one phrase; shorter items are ordinary expressions that clean texts hold too, and aren't searched for). A shard is one Arrow
batch of documents. Its text becomes a sequence of word numbers over the phrases' words; any other word can't be part of a
match, so a run of them is one separator, and stretches too short for any phrase go too. That loses no match, and what
remains is indexed in full (``whole``: every stretch and every separator is): suffix array by prefix doubling,
Burrows-Wheeler transform, wavelet matrix for ranks. All phrases are searched backwards at once; occurrences are located by walking
to the next sampled suffix position, and overlapping or touching ones merge to removal spans.

Phrases are cut, and their items gathered, by Spark; distinct ones come to the driver in groups of at most ``group_phrases`` to be
broadcast. One group takes one pass over the texts and no shuffle. Beyond, each group takes a pass, and spans of a text are brought together
by its hash and merged by word positions on the uncut text, so the result is the same for any size of group.
Words compare by 64-bit hashes of their lower case, so case and punctuation don't matter.

Cutting goes on until no phrase is left: words that stand side by side only after a cut can form one.

Defined results: null or empty texts and items give nothing. Repeated rows give repeated results; a span names all items that hold
any of its phrases, each once. An empty benchmark or an empty table leaves the documents as they are. Texts are searched whole whatever
their length. Null item ids have no name in ``items``, but their passages are found and cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, col, fresh, list_of, materialize, ranges, replace_spans, scan

PHRASE_WORDS, LEAST_WORDS, GROUP_PHRASES, SAMPLE_EVERY = 8, 5, 1_000_000, 16
_SPAN = "struct<start: int, end: int, first: int, last: int, items: array<long>>"


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; after each round only suffixes that are not yet told apart are sorted on."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.concatenate([[True], np.diff(seq[order]) != 0])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group + 1
    rank[n] = 0
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(size > 1, size)]
    k = 1
    while len(active):
        key = rank[active] * (n + 1) + rank[np.minimum(active + k, n)]
        o = np.argsort(key, kind="stable")
        active, key = active[o], key[o]
        old = rank[active]
        at = np.arange(len(active))
        old_new = np.concatenate([[True], np.diff(old) != 0])
        key_new = np.concatenate([[True], np.diff(key) != 0])
        old_start = np.maximum.accumulate(np.where(old_new, at, 0))
        key_start = np.maximum.accumulate(np.where(key_new, at, 0))
        rank[active] = old + key_start - old_start
        size = np.diff(np.append(np.flatnonzero(key_new), len(active)))
        active = active[np.repeat(size > 1, size)]
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank[:n] - 1] = np.arange(n)
    return sa


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(sigma - 1).bit_length())
        for b in range(self.bits - 1, -1, -1):
            one = ((seq >> b) & 1).astype(bool)
            self.levels.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int64))
            self.zeros.append(int((~one).sum()))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        start = np.zeros(len(i), np.int64)
        for level, zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            one = ((c >> b) & 1).astype(bool)
            i = np.where(one, zeros + level[i], i - level[i])
            start = np.where(one, zeros + level[start], start - level[start])
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            one = level[i + 1] > level[i]
            c = (c << 1) | one
            i = np.where(one, zeros + level[i], i - level[i])
        return c


class FMIndex:
    """Of a sequence of numbers 1 ... sigma - 1; 0 is the end."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        seq = np.append(seq, 0)
        self.n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.tree = WaveletMatrix(bwt, sigma)
        self.marked = sa % every == 0
        self.position = sa[self.marked]
        self.before = np.concatenate([[0], np.cumsum(self.marked)])

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes begin with each phrase, all phrases a step at a time from their ends."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            hi[live] = np.maximum(lo[live], hi[live])
            live = live[hi[live] > lo[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), 0
        at = np.arange(len(rows))
        while len(at):
            done = self.marked[rows]
            out[at[done]] = self.position[self.before[rows[done]]] + steps
            at, rows = at[~done], rows[~done]
            c = self.tree.access(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """Phrases as rows of word numbers, by length; word numbers start at 2, 1 separates.

    ``rows``: by length the phrases' word hashes, (n, length), and each one's items.
    """

    def __init__(self, rows: dict[int, tuple[np.ndarray, list[list[int]]]], whole: bool = False):
        self.words = np.unique(np.concatenate([h.ravel() for h, _ in rows.values()])) if rows else np.zeros(0, np.uint64)
        self.rows = {n: np.searchsorted(self.words, h) + 2 for n, (h, _) in rows.items()}
        self.items = {n: items for n, (_, items) in rows.items()}
        self.least = min(self.rows, default=0)
        self.whole = whole

    def spans(self, texts: list[str | None], every: int = SAMPLE_EVERY) -> list[list[tuple[int, int, int, int, list[int]]]]:
        """Merged spans of each text: characters, then words (start, end, first, last, items), ends exclusive."""
        out: list[list] = [[] for _ in texts]
        if not len(self.words):
            return out
        seqs, docs, places, starts, ends = [], [], [], [], []
        for first, some in chunks(texts):
            h, doc, start, size = scan(some)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[at] == h
            # stretches of known words inside one text
            new = np.concatenate([[True], (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])])
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(h)))
            good = known[begin] & (length >= (1 if self.whole else self.least))
            begin, length = begin[good], length[good]
            if not len(begin):
                continue
            idx = ranges(begin, length)
            # a separator follows each stretch
            where = np.cumsum(length + 1) - 1
            total = int((length + 1).sum())
            seq = np.ones(total, np.int64)
            is_word = np.ones(total, bool)
            is_word[where] = False
            seq[is_word] = at[idx] + 2
            no = np.arange(len(h)) - np.searchsorted(doc, doc)
            for held, v in ((docs, doc + first), (places, no), (starts, start), (ends, start + size)):
                full = np.zeros(total, np.int64)
                full[is_word] = v[idx]
                held.append(full)
            seqs.append(seq)
        if not seqs:
            return out
        seq, doc, no, start, end = map(np.concatenate, (seqs, docs, places, starts, ends))
        index = FMIndex(seq, len(self.words) + 2, every)
        hits: list[tuple[int, int, int, list[int]]] = []
        for n, rows in self.rows.items():
            lo, hi = index.search(rows)
            found = np.flatnonzero(hi > lo)
            count = (hi - lo)[found]
            place = index.locate(ranges(lo[found], count))
            for p, which in zip(place.tolist(), np.repeat(found, count).tolist()):
                hits.append((int(doc[p]), p, p + n, self.items[n][which]))
        hits.sort(key=lambda x: x[:3])
        for d, a, b, items in hits:
            spans = out[d]
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
                spans[-1][2].update(items)
            else:
                spans.append([a, b, set(items)])
        return [[(int(start[a]), int(end[b - 1]), int(no[a]), int(no[b - 1]) + 1, sorted(i)) for a, b, i in spans] for spans in out]

    def cuts(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, list[int]]]]:
        """As ``spans``, and what has to go besides so that no phrase is left once they are cut; touching ones are one. Word positions are those of the last text."""
        out = self.spans(texts)
        todo = [i for i, spans in enumerate(out) if spans]
        while todo:
            left, kept = [], []
            for i in todo:
                # the characters that stay, as ranges of the text as it was
                edges = [0, *[x for s in out[i] for x in s[:2]], len(texts[i])]
                stay = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
                kept.append(stay)
                left.append("".join(texts[i][a:b] for a, b in stay))
            more = []
            for i, stay, spans in zip(todo, kept, self.spans(left)):
                if not spans:
                    continue
                begin = np.cumsum([0, *[b - a for a, b in stay]])
                new = [(s[0], s[1], s[4]) for s in out[i]]
                for a, b, _, _, items in spans:
                    # what is cut in between the pieces of this span is cut already
                    k, m = int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, b - 1, "right")) - 1
                    for j in range(k, m + 1):
                        x, y = stay[j]
                        new.append((x + max(0, a - int(begin[j])), min(y, x + b - int(begin[j])), items))
                new.sort(key=lambda s: s[:2])
                joined: list[list] = []
                for a, b, items in new:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                        joined[-1][2].update(items)
                    else:
                        joined.append([a, b, set(items)])
                out[i] = [(a, b, 0, 0, sorted(items)) for a, b, items in joined]
                more.append(i)
            todo = more
        return out


def phrase_table(benchmark: DataFrame, phrase_words: int = PHRASE_WORDS, least_words: int = LEAST_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(phrase, items)``: each distinct phrase as the bytes of its words' hashes, and the ids of the items that hold it."""
    schema = pa.schema([("phrase", pa.binary()), ("item", pa.int64())])

    def cut(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, some in chunks(b.column(1).to_pylist()):
                h, doc, _, _ = scan(some)
                begin = np.searchsorted(doc, np.arange(len(some) + 1))
                phrases, items = [], []
                for i in range(len(some)):
                    mine = h[begin[i] : begin[i + 1]]
                    n = min(phrase_words, len(mine))
                    if n >= least_words:
                        windows = {mine[k : k + n].tobytes() for k in range(len(mine) - n + 1)}
                        phrases += windows
                        items += [ids[first + i]] * len(windows)
                yield batch(schema, phrases, items)

    rows = benchmark.select(col(id_col).cast("long").alias("item"), col(text_col).alias("text")).where("text is not null").mapInArrow(cut, "phrase binary, item long")
    return rows.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def phrases_of(table: pa.Table, whole: bool = False) -> Phrases:
    """From rows of a phrase table."""
    by: dict[int, tuple[list[bytes], list[list[int]]]] = {}
    for phrase, items in sorted(zip(table.column("phrase").to_pylist(), table.column("items").to_pylist())):
        held = by.setdefault(len(phrase) // 8, ([], []))
        held[0].append(phrase)
        held[1].append(items)
    return Phrases({n: (np.frombuffer(b"".join(p), np.uint64).reshape(-1, n), items) for n, (p, items) in by.items()}, whole)


def _groups(docs: DataFrame, benchmark: DataFrame, phrase_words: int, least_words: int, group_phrases: int, item_col: str, item_text_col: str, whole: bool) -> list:
    """Broadcasts of ``Phrases``, each of a bounded number of them."""
    table = phrase_table(benchmark, phrase_words, least_words, item_col, item_text_col)
    n = table.count()
    if n > group_phrases:
        table = materialize(table, "phrases")
    parts = max(1, -(-n // group_phrases))
    share = lambda k: table if parts == 1 else table.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k)
    return [docs.sparkSession.sparkContext.broadcast(phrases_of(share(k).toArrow(), whole)) for k in range(parts)]


def _list(spans: list[list[tuple]]) -> pa.Array:
    flat = [s for x in spans for s in x]
    kinds = [("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("items", pa.list_(pa.int64()))]
    struct = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
    return list_of(np.fromiter(map(len, spans), np.int64, len(spans)), struct)


def _span_udf(phrases, cut: bool = False):
    @F.arrow_udf(f"array<{_SPAN}>")
    def leaks(v: pa.Array) -> pa.Array:
        return _list((phrases.value.cuts if cut else phrases.value.spans)(v.to_pylist()))

    return leaks.asNondeterministic()


def _merge(spans: Column) -> Column:
    """Spans of one text from several groups, overlapping or touching by words ones as one."""

    @F.arrow_udf(f"array<{_SPAN}>")
    def merge(v: pa.Array) -> pa.Array:
        out = []
        for some in v.to_pylist():
            joined: list[list] = []
            for s in sorted(some, key=lambda s: (s["first"], s["last"])):
                if joined and s["first"] <= joined[-1][3]:
                    last = joined[-1]
                    if s["last"] > last[3]:
                        last[1], last[3] = s["end"], s["last"]
                    last[4].update(s["items"])
                else:
                    joined.append([s["start"], s["end"], s["first"], s["last"], set(s["items"])])
            out.append([(*s[:4], sorted(s[4])) for s in joined])
        return _list(out)

    return merge(spans)


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def _gathered(docs: DataFrame, groups: list, text_col: str) -> DataFrame:
    """``(text_key, found)`` of the texts that any group's phrases stand in."""
    parts = [docs.select(_key(col(text_col)).alias("text_key"), F.explode(_span_udf(g)(col(text_col))).alias("s")) for g in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # equal texts have equal spans: one of each is left before any list is made
    return out.distinct().groupBy("text_key").agg(F.collect_list("s").alias("s")).select("text_key", _merge(F.col("s")).alias("found"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase_words: int = PHRASE_WORDS, least_words: int = LEAST_WORDS, group_phrases: int = GROUP_PHRASES, item_col: str = "item_id", item_text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(doc_id, start, end, items)``: character spans from 0, end exclusive, and the benchmark items they come from."""
    groups = _groups(docs, benchmark, phrase_words, least_words, group_phrases, item_col, item_text_col, whole)
    if len(groups) == 1:
        out = docs.select(col(id_col).alias("doc_id"), _span_udf(groups[0])(col(text_col)).alias("found"))
    else:
        found = _gathered(docs, groups, text_col)
        out = docs.select(col(id_col).alias("doc_id"), _key(col(text_col)).alias("text_key")).join(found, "text_key")
    return out.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.start", "s.end", "s.items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", phrase_words: int = PHRASE_WORDS, least_words: int = LEAST_WORDS, group_phrases: int = GROUP_PHRASES, item_col: str = "item_id", item_text_col: str = "text", whole: bool = False) -> DataFrame:
    """The documents with benchmark passages cut from the text, all columns kept; the length column follows the text. Texts that nothing is left of go."""
    spans, cut, key, other = fresh(docs, "spans", "cut", "key", "other")
    names = docs.columns
    groups = _groups(docs, benchmark, phrase_words, least_words, group_phrases, item_col, item_text_col, whole)

    def without(found: DataFrame) -> DataFrame:
        out = found.withColumn(cut, replace_spans(col(text_col), col(spans)))
        hit = F.size(col(spans)) > 0
        new = {text_col: col(cut)}
        if length_col in names:
            new[length_col] = F.when(hit, F.length(col(cut)).cast(docs.schema[length_col].dataType)).otherwise(col(length_col))
        return out.where(~hit | (F.length(F.trim(col(cut))) > 0)).select(*[new.get(c, col(c)).alias(c) for c in names])

    if len(groups) == 1:
        return without(docs.withColumn(spans, _span_udf(groups[0], cut=True)(col(text_col))))
    while True:
        found = materialize(_gathered(docs, groups, text_col), "leaks")
        if found.isEmpty():
            return docs
        marked = docs.withColumn(key, _key(col(text_col)))
        marked = marked.join(found.select(F.col("text_key").alias(other), F.col("found").alias(spans)), col(key) == col(other), "left")
        docs = materialize(without(marked.withColumn(spans, F.coalesce(col(spans), F.array().cast(f"array<{_SPAN}>")))), "cut")
