"""Feature transforms as native column expressions: arrays of words in, arrays or strings out."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"
SHAPE_TOKENS = r"[\p{L}\p{N}\p{P}]+"
#: BCP-47 primary subtags to ISO 639-2.
ISO_639 = {
    "en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "sv": "swe", "da": "dan", "no": "nor", "fi": "fin", "pl": "pol", "cs": "ces", "hu": "hun",
    "ro": "ron", "bg": "bul", "el": "ell", "ru": "rus", "uk": "ukr", "tr": "tur", "ar": "ara", "he": "heb", "fa": "fas", "hi": "hin", "bn": "ben", "ta": "tam", "th": "tha", "vi": "vie",
    "id": "ind", "ms": "msa", "zh": "zho", "ja": "jpn", "ko": "kor", "sw": "swa", "ca": "cat", "hr": "hrv", "sr": "srp", "sk": "slk", "sl": "slv", "et": "est", "lv": "lav", "lt": "lit",
}


def words(text: Column, pattern: str = WORDS) -> Column:
    """Lower-cased words in order; of null the empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def content_type(content: Column, from_news_feed: Column | None = None) -> Column:
    """HTML or XML by the text's first characters; documents of markup-only feeds are HTML; else PlainText."""
    rest = F.lit("PlainText") if from_news_feed is None else F.when(from_news_feed, "HTML").otherwise("PlainText")
    start = F.lower(F.substring(content, 1, 10))
    return F.when(start == "<!doctype ", "HTML").when(F.substring(start, 1, 6) == "<?xml ", "XML").otherwise(rest)


def normalize_language(code: Column) -> Column:
    """Alpha-3 code of a BCP-47 tag, of an alpha-3 code itself; null where there is none."""
    first = F.lower(F.split(F.trim(code), "[-_]")[0])
    known = F.create_map(*[F.lit(x) for k, v in ISO_639.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, first), F.when(first.isin(*ISO_639.values()), first))


def change_case(word: Column, how: str | None, language: Column | None = None) -> Column:
    """``ToLower``, ``ToUpper`` or no change; Turkish dotted and dotless i keep apart."""
    if how in (None, "None"):
        return word
    if how not in ("ToLower", "ToUpper"):
        raise ValueError(f"unknown case transform {how!r}")
    fold, pairs = (F.lower, ("Iİ", "ıi")) if how == "ToLower" else (F.upper, ("ıi", "Iİ"))
    plain = fold(word)
    return plain if language is None else F.when(language == "tur", fold(F.translate(word, *pairs))).otherwise(plain)


def filter_tags(tokens: Column, accept: list[str]) -> Column:
    """Tokens (structs with ``tag``) whose tag is accepted."""
    return F.filter(tokens, lambda t: t["tag"].isin(*accept))


def bag_of_words(tokens: Column, accept: list[str], how: str | None = "ToLower", language: Column | None = None) -> Column:
    """Case-folded contents of accepted tokens; order and duplicates stay."""
    return F.transform(filter_tags(tokens, accept), lambda t: change_case(t["content"], how, language))


def drop_stopwords(array: Column, stopwords: Column) -> Column:
    """Words that are not in the stop list; duplicates stay; no list drops nothing."""
    return F.when(stopwords.isNull(), array).otherwise(F.filter(array, lambda w: ~F.array_contains(stopwords, w)))


def _window(array: Column, n: int):
    return lambda i: F.slice(array, i, n)


def _picked(array: Column, offsets: list[int]):
    return lambda i: F.array(*[F.element_at(array, i + x) for x in offsets])


def ngrams(array: Column, least: int = 1, most: int = 3) -> Column:
    """All windows of ``most`` down to ``least`` items, long ones first, as arrays; none if there are fewer items than ``least``."""
    if not 1 <= least <= most:
        raise ValueError("1 <= least <= most")
    empty = F.array().cast("array<array<string>>")
    size = F.size(array)
    parts = []
    for n in range(most, least - 1, -1):
        starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))))
        parts.append(F.coalesce(F.transform(starts, _window(array, n)), empty))
    return F.when(size >= least, F.concat(*parts)).otherwise(empty)


def skipgrams(array: Column, k: int = 2, n: int = 2) -> Column:
    """Grams of n items with up to k items skipped in each gap, as arrays."""
    if n < 1 or k < 0:
        raise ValueError("n >= 1 and k >= 0")
    empty = F.array().cast("array<array<string>>")
    size = F.size(array)
    parts = []
    for skips in itertools.product(range(k + 1), repeat=n - 1):
        offsets = list(itertools.accumulate((s + 1 for s in skips), initial=0))
        last = offsets[-1]
        starts = F.when(size > last, F.sequence(F.lit(1), F.greatest(size - last, F.lit(1))))
        parts.append(F.coalesce(F.transform(starts, _picked(array, offsets)), empty))
    return F.when(size >= min(n, k), F.reverse(F.concat(*parts))).otherwise(empty)


def word_shape(word: Column) -> Column:
    """Upper, lower, digit, space and other runs as C, c, n, s and p, doubled where longer than one letter or digit."""
    out = word
    for pattern, to in ((r"\p{Lu}", "C"), ("CC+", "CC"), (r"\p{Ll}", "c"), ("cc+", "cc"), (r"\p{Nd}", "n"), ("nn+", "nn"), (r"\p{Zs}+", "s"), ("[^snCc]+", "p")):
        out = F.regexp_replace(out, pattern, to)
    return out


def lift(*columns: Column) -> Column:
    """Single features as one sequence."""
    return F.array(*columns)


def chain_lift(*chains: Column) -> Column:
    """Chains collated link by link; features of later chains stand first."""
    if len(chains) == 1:
        return F.transform(chains[0], lambda x: F.array(x))
    zipped = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(chains)])
    names = [f"c{i}" for i in range(len(chains))]
    return F.transform(zipped, lambda x: F.array(*[x[n] for n in reversed(names)]))


def chain_neighborhood(chain: Column, before: int, after: int) -> Column:
    """For each link the neighbours as ``struct<offset, feature>``: -1 ... -before, then 1 ... after."""
    if not (0 <= before <= 127 and 0 <= after <= 127):
        raise ValueError("a neighbourhood reaches at most 127 links")
    size = F.size(chain)

    def around(_: Column, i: Column) -> Column:
        near = []
        for d in [*range(-1, -before - 1, -1), *range(1, after + 1)]:
            at = i + d
            near.append(F.when((at >= 0) & (at < size), F.struct(F.lit(d).cast("byte").alias("offset"), F.get(chain, at).alias("feature"))))
        return F.filter(F.array(*near), lambda x: x.isNotNull()) if near else F.array()

    return F.transform(chain, around)


def display(parts: Column) -> Column:
    """What people read of a product feature: its parts joined by spaces."""
    return F.array_join(parts, " ")


def key(parts: Column) -> Column:
    """What identifies a product feature."""
    return F.array_join(parts, "\u0001")


def sha1_name(value: Column) -> Column:
    return F.upper(F.substring(F.sha1(value), 1, 12))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def to_utf16(text: Column, offset: Column, length: Column) -> tuple[Column, Column]:
    """Offset and length in code points to UTF-16 units, clipped to the text; (0, 0) for those without length, wholly before or beyond the text, no length for one at its end."""
    n = F.length(text)
    start = F.greatest(offset, F.lit(0))
    left = length + F.least(offset, F.lit(0))
    size = F.least(left, n - start)
    inside = (offset <= n) & (length > 0) & (left > 0)
    at = utf16_length(F.substring(text, F.lit(1), start))
    return F.when(inside, at).otherwise(0), F.when(inside, utf16_length(F.substring(text, start + 1, size))).otherwise(0)


def from_utf16(text: Column, offset: Column, length: Column) -> tuple[Column, Column]:
    """The inverse of ``to_utf16``; a half of a surrogate pair counts as the whole."""
    units = F.encode(text, "UTF-16BE")
    points = lambda b: F.length(F.decode(b, "UTF-16BE"))
    n = utf16_length(text)
    start = F.greatest(offset, F.lit(0))
    left = length + F.least(offset, F.lit(0))
    size = F.least(left, n - start)
    inside = (offset <= n) & (length > 0) & (left > 0)
    at = points(F.substring(units, F.lit(1), start * 2))
    return F.when(inside, at).otherwise(0), F.when(inside, points(F.substring(units, start * 2 + 1, size * 2))).otherwise(0)


FORCED, RULE = 1, 2


def has_flag(flags: Column, mask: int) -> Column:
    return F.expr("0") != flags.bitwiseAND(mask)


def bio_kind(tag: Column) -> Column:
    """B, I or O of a tag; anything else is an error."""
    first = F.substring(tag, 1, 1)
    ok = (tag == "O") | (first.isin("B", "I") & (F.length(tag) > 1))
    return F.when(ok, first).otherwise(F.raise_error(F.concat(F.lit("not a BIO tag: "), tag)))


def bio_label(tag: Column) -> Column:
    return F.when(tag != "O", F.substring(tag, 2, 1_000_000))
