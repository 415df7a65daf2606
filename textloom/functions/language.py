"""Language detection: spans of one script, chunks scored by character trigrams learned from labelled documents, totals and what they are worth.

Markup is stripped and references are expanded first. Letters of a script of one language speak for it. The others' words are cut to
trigrams, chunks of ``CHUNK`` of them are each given to their likeliest language, and a document's languages are those of its letters, at most
three. Languages whose chunks are hardly likelier than the next are dropped, close pairs go to the more frequent one, and English (or
French, Italian, German, Spanish) that a smaller, less common language stands beside is taken for boilerplate. Hints, such as
a declared language or a domain, weigh a little on every trigram. Repetitive texts are judged by their distinct lines and words.

A batch of texts is a few arrays of numbers; there is no loop over characters or trigrams.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stopwords
from .columns import ISO_639, normalize_language

#: Scripts of one language.
SCRIPTS = [("Hangul", "kor"), ("Hiragana", "jpn"), ("Katakana", "jpn"), ("Thai", "tha"), ("Greek", "ell"), ("Hebrew", "heb"), ("Armenian", "hye"), ("Georgian", "kat"), ("Tamil", "tam"), ("Bengali", "ben"), ("Devanagari", "hin"), ("Han", "zho"), ("Arabic", "ara"), ("Cyrillic", "rus")]
_TAGS = regex.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", regex.DOTALL | regex.IGNORECASE)
GRAM, PROFILE = 3, 3000
#: Trigrams of a chunk; difference to the next language, a trigram, that is fully reliable; least reliability.
CHUNK, SURE, LEAST_RELIABLE = 64, 0.25, 0.41
#: Shares of letters: of the language beside English boilerplate, beside that of other common languages, of a first language to be reliable.
BESIDE_ENGLISH, BESIDE_COMMON, GOOD_FIRST = 0.17, 0.20, 0.26
#: What a hint adds to a trigram's log probability.
HINT = 0.1
#: From so many characters on a text of such a share of blanks, or of lines and words seen before, is judged by its distinct ones.
SQUEEZE_FROM, BLANKS, REPEATED = 256, 0.25, 0.67
COMMON = frozenset(("eng", "fra", "ita", "deu", "spa"))
CLOSE = [frozenset(x.split()) for x in ("ind msa", "hrv srp bos", "ces slk", "dan nor nno", "por glg", "bul mkd", "hin mar nep", "rus ukr bel", "ara fas urd")]
#: Languages by country domain.
DOMAINS = dict(x.split(":") for x in "de:deu at:deu fr:fra es:spa mx:spa ar:spa it:ita pt:por br:por nl:nld se:swe dk:dan no:nor fi:fin pl:pol cz:ces hu:hun ro:ron bg:bul gr:ell ru:rus ua:ukr tr:tur il:heb ir:fas in:hin th:tha vn:vie id:ind cn:zho tw:zho jp:jpn kr:kor uk:eng us:eng".split())


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> dict[str, dict[str, float]]:
    """``{language: {n-gram: log probability}}`` of each language's commonest n-grams; counted in one shuffle, a bounded table collected."""
    from pyspark.sql import Window as W

    words = docs.select(normalize_language(F.col(lang_col)).alias("lang"), F.explode_outer(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).where("w is not null and lang is not null")
    # equal words have equal grams: they are cut up once
    words = words.groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn("p", F.concat(F.lit("_"), "w", F.lit("_")))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - (GRAM - 1)), lambda i: F.substring("p", i, F.lit(GRAM)))).alias("g"))
    counts = grams.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "g"))
    total = F.sum("n").over(W.partitionBy("lang"))
    rows = counts.withColumn("total", total).withColumn("rank", rank).where(F.col("rank") <= profile).collect()
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r.lang, {})[r.g] = math.log(r.n / r.total)
    return out


#: The first article, and of some languages more, of the Universal Declaration of Human Rights: with the stop words, profiles for where no documents are labelled.
SAMPLES = {
    "eng": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude. Everyone has the right to education, and elementary education shall be compulsory.",
    "fra": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude. Toute personne a droit à l'éducation, et l'enseignement élémentaire est obligatoire.",
    "deu": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden. Jeder hat das Recht auf Bildung.",
    "spa": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Toda persona tiene los derechos y libertades proclamados en esta Declaración, sin distinción alguna. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre. Toda persona tiene derecho a la educación.",
    "ita": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "por": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nld": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "swe": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "dan": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    "fin": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pol": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "tur": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ind": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
}


def default_profiles() -> dict[str, dict[str, float]]:
    out = {}
    for lang, sample in SAMPLES.items():
        words = regex.findall(r"\p{L}+", sample.lower()) + stopwords.LISTS.get(lang, "").split()
        grams = Counter(p[i : i + GRAM] for w in words for p in (f"_{w}_",) for i in range(len(p) - GRAM + 1))
        total = sum(grams.values())
        out[lang] = {g: math.log(n / total) for g, n in grams.items()}
    # one floor for all: a language isn't likelier for having a shorter sample
    least = min(min(v.values()) for v in out.values())
    return {k: {**v, "___": least} for k, v in out.items()}


class Profiles(NamedTuple):
    """Trigrams as sorted numbers, and by trigram and language log probabilities."""

    languages: list[str]
    keys: np.ndarray
    table: np.ndarray
    floor: np.ndarray


def compile_profiles(profiles: dict[str, dict[str, float]]) -> Profiles:
    languages = sorted(k for k, v in profiles.items() if v)
    grams = sorted({g for k in languages for g in profiles[k] if len(g) == GRAM})
    keys = np.array([_key(*map(ord, g.replace("_", " "))) for g in grams], np.uint64)
    floor = np.array([min(profiles[k].values()) - 1 for k in languages])
    table = np.array([[profiles[k].get(g, f) for k, f in zip(languages, floor)] for g in grams]).reshape(len(grams), len(languages))
    order = np.argsort(keys)
    return Profiles(languages, keys[order], table[order], floor)


def _key(a: int, b: int, c: int) -> int:
    return a << 42 | b << 21 | c


_LOOKUP: list[np.ndarray] = []


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Of the basic plane's characters: whether a letter, and the number of its script of one language plus 1."""
    if not _LOOKUP:
        chars = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
        letter, script = np.zeros(0x10000, bool), np.zeros(0x10000, np.int8)
        letter[[ord(c) for c in chars if c.isalpha()]] = True
        for k, (name, _) in enumerate(SCRIPTS, 1):
            found = [ord(c) for c in regex.findall(rf"\p{{{name}}}", chars)]
            script[found] = k
        script[~letter] = 0
        _LOOKUP[:] = [letter, script]
    return _LOOKUP[0], _LOOKUP[1]


def plain(text: str, is_html: bool) -> str:
    return html.unescape(_TAGS.sub(" ", text)) if is_html else text


def squeezed(text: str) -> str | None:
    """The distinct lines and words of a text of many blanks or repetitions, in order; None for others."""
    if len(text) < SQUEEZE_FROM:
        return None
    words = re.split(r"\s+", text)
    blanks = 1 - sum(map(len, words)) / len(text)
    if blanks < BLANKS and len(set(words)) > (1 - REPEATED) * len(words):
        return None
    return " ".join(dict.fromkeys(words))


class Found(NamedTuple):
    language: str
    share: float
    reliability: float


def _totals(texts: list[str], p: Profiles, hints: list[list[str]]) -> list[list[Found]]:
    """Each text's languages by letters, before they are judged."""
    letter, script = _lookup()
    n, kinds = len(texts), len(SCRIPTS) + 1
    cp = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le"), np.uint32)
    breaks = np.array([len(t.lower()) for t in texts], np.int64)
    doc = np.repeat(np.arange(n), breaks + 1)[: len(cp)]
    base = np.where(cp < 0x10000, cp, 0)
    is_letter, kind = letter[base], script[base]
    by_script = np.bincount(doc[is_letter] * kinds + kind[is_letter], minlength=n * kinds).reshape(n, kinds)
    shares: list[dict[str, list[float]]] = [{} for _ in texts]
    for d, k in zip(*np.nonzero(by_script[:, 1:])):
        held = shares[d].setdefault(SCRIPTS[k][1], [0.0, 0.0])
        held[0] += float(by_script[d, k + 1])
        held[1] += float(by_script[d, k + 1])
    for d in np.flatnonzero(by_script[:, [i + 1 for i, (_, c) in enumerate(SCRIPTS) if c == "jpn"]].sum(1)):
        # Han letters between kana are Japanese
        if "zho" in shares[d] and shares[d]["jpn"][0] > 0.1 * shares[d]["zho"][0]:
            extra = shares[d].pop("zho")
            shares[d]["jpn"] = [shares[d]["jpn"][0] + extra[0], shares[d]["jpn"][1] + extra[1]]
    if len(p.languages) and len(cp) > 2:
        # words of the other scripts with one blank between them
        mine = is_letter & (kind == 0)
        keep = mine | np.append(True, mine[:-1]) & ~mine
        seq, owner = np.where(mine, cp, 32)[keep].astype(np.uint64), doc[keep]
        seq, owner = np.append(np.uint64(32), seq), np.append(owner[:1], owner)
        if len(seq) > 2:
            a, b, c = seq[:-2], seq[1:-1], seq[2:]
            good = b != 32
            key = (a << np.uint64(42) | b << np.uint64(21) | c)[good]
            d = owner[1:-1][good]
            if len(key):
                at = np.minimum(np.searchsorted(p.keys, key), len(p.keys) - 1)
                known = p.keys[at] == key
                first = np.searchsorted(d, np.arange(n))
                chunk_start = np.flatnonzero((np.arange(len(d)) - first[d]) % CHUNK == 0)
                sizes = np.diff(np.append(chunk_start, len(d)))
                gram = np.where(known[:, None], p.table[at], p.floor[None, :])
                sums = np.add.reduceat(gram, chunk_start, axis=0)
                of = d[chunk_start]
                for i in {int(x) for x in of}:
                    for h in hints[i]:
                        if h in p.languages:
                            sums[of == i, p.languages.index(h)] += HINT * sizes[of == i]
                order = np.sort(sums, axis=1)
                gap = (order[:, -1] - order[:, -2]) / sizes if sums.shape[1] > 1 else np.full(len(sums), SURE)
                sure, best = np.minimum(1.0, gap / SURE), sums.argmax(1)
                for i, k, m, r in zip(of.tolist(), best.tolist(), sizes.tolist(), sure.tolist()):
                    held = shares[i].setdefault(p.languages[k], [0.0, 0.0])
                    held[0] += m
                    held[1] += m * r
    out = []
    for s in shares:
        total = sum(x for x, _ in s.values())
        out.append(sorted((Found(k, x / total, r / x) for k, (x, r) in s.items()), key=lambda f: (-f.share, f.language)))
    return out


def judged(found: list[Found]) -> list[Found]:
    """Close pairs joined, unreliable languages dropped, boilerplate put behind; at most three."""
    by = {f.language: f for f in found}
    for group in CLOSE:
        mine = [f for f in found if f.language in group]
        if len(mine) > 1:
            share = sum(f.share for f in mine)
            by[mine[0].language] = Found(mine[0].language, share, sum(f.share * f.reliability for f in mine) / share)
            for f in mine[1:]:
                by.pop(f.language)
    rows = sorted(by.values(), key=lambda f: (-f.share, f.language))
    rows = [f for f in rows if f.reliability >= LEAST_RELIABLE] or rows[:1]
    if len(rows) > 1:
        first, second = rows[:2]
        if first.language == "eng" and second.share >= BESIDE_ENGLISH or first.language in COMMON and second.language not in COMMON and second.share >= BESIDE_COMMON:
            rows[:2] = [second, first]
    return rows[:3]


def classify(texts: list[str], profiles: Profiles, hints: list[list[str]] | None = None) -> list[list[Found]]:
    """Languages of each plain text, the best first; none where there are no letters."""
    hints = hints or [[] for _ in texts]
    out: list[list[Found]] = []
    first, size = 0, 0
    for i, t in enumerate([*texts, ""]):
        size += len(t)
        if i == len(texts) or size > 200_000:
            part = [squeezed(x) or x for x in texts[first : i + 1]]
            out += [judged(f) for f in _totals(part, profiles, hints[first : i + 1])] if part else []
            first, size = i + 1, 0
    return out


def reliable(found: list[Found]) -> bool:
    return bool(found) and found[0].share >= GOOD_FIRST and found[0].reliability >= LEAST_RELIABLE


def detect(df: DataFrame, text: Column, is_html: Column, profiles: dict[str, dict[str, float]], top: int = 3, hints: Column | None = None) -> Column:
    """``array<struct<language, score, reliable>>``, the best first, the score its share of letters; empty where there are no letters. ``hints``: an array of language codes."""
    shared = df.sparkSession.sparkContext.broadcast(compile_profiles(profiles))
    rows = pa.list_(pa.struct([("language", pa.string()), ("score", pa.float64()), ("reliable", pa.bool_())]))

    @F.arrow_udf("array<struct<language: string, score: double, reliable: boolean>>")
    def run(v: pa.Array, h: pa.Array, hint: pa.Array) -> pa.Array:
        texts = [plain(t or "", bool(x)) for t, x in zip(v.to_pylist(), h.to_pylist())]
        given = [[x for x in xs or [] if x] for xs in hint.to_pylist()]
        return pa.array([[{"language": f.language, "score": f.share, "reliable": i > 0 or reliable(found)} for i, f in enumerate(found[:top])] for found in classify(texts, shared.value, given)], rows)

    return run.asNondeterministic()(text, is_html, F.array().cast("array<string>") if hints is None else hints)


def detect_first(text: Column, is_html: Column, profiles: Profiles) -> Column:
    """The first language of a text, null where there is none; small profiles travel with the plan."""

    @F.arrow_udf("string")
    def first(v: pa.Array, h: pa.Array) -> pa.Array:
        texts = [plain(t or "", bool(x)) for t, x in zip(v.to_pylist(), h.to_pylist())]
        return pa.array([found[0].language if found else None for found in classify(texts, profiles)], pa.string())

    return first.asNondeterministic()(text, is_html)


def language(known: Column, detected: Column) -> Column:
    """The document's declared language if it resolves, else the detected one."""
    return F.coalesce(normalize_language(known), F.get(detected, F.lit(0))["language"])


def html_hint(markup: Column) -> Column:
    """Language that a page declares, in its root element or in a content-language header element."""
    root = F.regexp_extract(markup, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z\-]+)", 1)
    meta = F.regexp_extract(markup, r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?content-language[\"']?[^>]*\bcontent\s*=\s*[\"']?([A-Za-z\-]+)", 1)
    return F.coalesce(normalize_language(F.nullif(root, F.lit(""))), normalize_language(F.nullif(meta, F.lit(""))))


def domain_hint(url: Column) -> Column:
    """Language of an address's country domain."""
    host = F.regexp_extract(url, r"^[a-z]+://[^/:?#]*?\.([a-z]{2})(?:[/:?#]|$)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in DOMAINS.items() for x in (k, v)]), host)


def language_ids() -> dict[str, int]:
    """Numbers of the languages this package knows, in the order of their codes, from 1; 0 is the unknown one."""
    codes = sorted({*ISO_639.values(), *(c for _, c in SCRIPTS), *DOMAINS.values()})
    return {"und": 0} | {c: i for i, c in enumerate(codes, 1)}
