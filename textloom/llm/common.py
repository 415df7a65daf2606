"""Shared helpers of the corpus operators.

Every operator selects the columns it needs by position-independent name first, so extra columns,
whatever they are called, cannot clash with the ones it adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clean, discard, forget, materialize, shared_dir, written  # noqa: F401

WORD = re.compile(r"\w+")
#: Characters of text that a Python worker turns into arrays at a time.
CHUNK_CHARS = 200_000
_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: str) -> list[str]:
    """Lower-cased ``\\w+`` words; as many as ``WORD`` finds in the text as it stands."""
    low = text.lower()
    if len(low) == len(text):
        return WORD.findall(low)
    return [w.lower() for w in WORD.findall(text)]


def chunks(texts: Iterable[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts of about ``chars`` characters, null as empty, with the first one's index."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > chars:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n)])`` without a loop."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Of every character of the basic plane: class (0 space, 1 word, 2 other), value of its lower case; powers of the base."""
    if not _TABLES:
        chars = [chr(c) for c in range(0x10000)]
        kind = np.array([1 if c.isalnum() or c == "_" else 0 if c.isspace() else 2 for c in chars], np.uint8)
        low = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint64)
        _TABLES[:] = [kind, mix64(low + np.uint64(0x9E3779B97F4A7C15)), np.ones(1, np.uint64)]
    return _TABLES


_BASE = np.uint64(0xD1342543DE82EF95)


def scan(texts: list[str], symbols: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the texts, in order: hash of its lower case, text's index, offset in the text, length.

    A word is a longest run of letters, digits and underscores, as ``\\w+`` finds. ``symbols``: runs of
    characters that are neither words nor space count too. Case folds character by character. Hashes
    depend on nothing but the word, so all workers agree on them.
    """
    kind, value, power = _tables()
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    astral = np.flatnonzero(cp >= 0x10000)
    base = cp
    if len(astral):
        base = cp.copy()
        base[astral] = 0
    k = kind[base]
    for c in np.unique(cp[astral]).tolist():
        k[astral[cp[astral] == c]] = 1 if chr(c).isalnum() else 0 if chr(c).isspace() else 2
    if not symbols:
        k[k == 2] = 0
    edge = np.flatnonzero(k[1:] != k[:-1]) + 1
    edge = np.concatenate([np.zeros(1, np.int64), edge])
    run = k[edge] != 0 if len(k) else np.zeros(1, bool)
    start, size = edge[run], np.diff(np.append(edge, len(k)))[run]
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    longest = int(size.max())
    if longest > len(power):
        power = _TABLES[2] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * longest, _BASE)]))
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    local = at - np.repeat(begin, size)
    place = local + np.repeat(start, size)
    v = value[base[place]]
    if len(astral):
        far = cp[place]
        big = np.flatnonzero(far >= 0x10000)
        v[big] = mix64(np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in far[big].tolist()], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = mix64(np.add.reduceat(v * power[local], begin))
    doc = np.searchsorted(first, start, "right") - 1
    return h, doc, start - first[doc], size


def word_hash(word: str) -> int:
    """The hash that ``scan`` gives this word."""
    return int(scan([word], True)[0][0])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def replace_spans(text: Column, spans: Column, filler: str = "") -> Column:
    """``text`` without the characters of ``spans``, an array of disjoint ascending ``struct<start, end>`` from 0; ``filler`` in each one's place."""
    n = F.size(spans)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(spans, F.greatest(i, F.lit(1)))["end"])
    end = lambda i: F.when(i == n, F.length(text)).otherwise(F.element_at(spans, F.least(i + 1, n))["start"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i)))
    return F.when(n > 0, F.array_join(pieces, filler)).otherwise(text)


def list_of(counts: np.ndarray, structs: pa.Array) -> pa.Array:
    """Lists of the given lengths over one flat array."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), structs)
