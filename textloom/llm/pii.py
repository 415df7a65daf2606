"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Candidates come from permissive patterns: whatever any labeler can vote for, every typed reading of a stretch of digits and every pair
of capitalised words among them; they may overlap. Regex, gazetteer and context labelers each vote for, against or not at all. Votes
are counted by pattern over the whole corpus, a table whose size the labelers bound; from it expectation-maximisation
estimates each labeler's reliability and each pattern's probability (a Beta prior keeps labelers better than chance). These
probabilities are the soft targets of the final span classifier, a logistic regression on votes and surface features,
again fitted on counts of equal rows, and applied to every candidate. Of candidates that overlap, the likelier stays.

Texts are read once: candidates are written to the shared folder, a list of numbers a document, and counted and scored from there. Nothing
is shuffled but one row a pattern and task.

Defined results: null and empty texts have no candidates. Repeated rows count as often as they occur. With no candidates, as in an
empty table, the result is empty. Texts are read whole whatever their length. A candidate that no labeler votes for is none. Overlapping
candidates: the likelier goes first, of equals the longer, then the earlier kind in ``KINDS``, then the earlier in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, list_of, materialize

KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "name")
LABELERS = ("strict", "valid", "gazetteer", "context", "counter")
THRESHOLD, ROUNDS, PRIOR = 0.5, 50, (8.0, 2.0)
#: Most names that a gazetteer file may have; it is broadcast.
MOST_NAMES = 2_000_000
_AT = re.compile(r"[\w.+\-]{1,64}@[\w\-]+(?:\.[\w\-]+)*")
#: Stretches in which numbers are looked for, and their typed readings.
_ZONE = re.compile(r"[+(]{0,2}\d[\d.\-() ]{5,}\d")
_CARD = re.compile(r"(?<!\d)(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ \-])\d{6}\2\d{5}|\d{13,19})(?!\d)")
_SSN = re.compile(r"(?<!\d)\d{3}([ \-]?)\d{2}\1\d{4}(?!\d)")
_IP = re.compile(r"(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)")
_PHONE = re.compile(r"(?:\+|(?<!\d)00)\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]\d{2,4}){1,3}(?!\d)|(?<!\d)\d{2,5}([ .\-])\d{2,4}(?:\1\d{2,4}){1,3}(?!\d)|(?<!\d)\d{7,15}(?!\d)")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_UPPER = "[" + "".join(c for c in map(chr, range(0x10000)) if c.isupper()) + "]"
_PAIR = re.compile(rf"\b(?=({_UPPER}[^\W\d_]*(?:['’\-][^\W\d_]+)*) ({_UPPER}[^\W\d_]*(?:['’\-][^\W\d_]+)*)(?!\w)){_UPPER}")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|M|Sr|Sra|Señor|Señora)\.? $")
_TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Sr Sra Señor Señora Dear Name".split())
_EMAIL = re.compile(r"[\w.+\-]+@(?:[\w\-]+\.)+[A-Za-z]{2,}")
TLDS = frozenset("com org net edu gov mil int io co info biz dev app ai me tv name pro eu us uk ca au nz ie de at ch fr es it pt nl be lu dk se no fi is pl cz sk hu ro bg gr tr ru ua by ee lv lt si hr rs cn jp kr tw hk sg in id my th vn ph br mx ar cl co pe ve za ng ke eg ma il ae sa ir example".split())
CARD_PREFIXES = tuple("4 51 52 53 54 55 34 37 6011 64 65 35 30 36 38 22 23 24 25 26 27".split())
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra "
    "Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Ronald Rebecca Jason Sharon Edward Laura Jeffrey "
    "Cynthia Ryan Dorothy Jacob Amy Gary Kathleen Nicholas Angela Eric Shirley Jonathan Emma Stephen Brenda Larry Pamela Justin Nicole Scott Anna Brandon Samantha Benjamin Katherine Samuel Christine Gregory Debra "
    "Alexander Rachel Patrick Carolyn Frank Janet Raymond Maria Jack Olivia Dennis Heather Jerry Helen Tyler Catherine Aaron Diane Jose Julie Adam Victoria Nathan Joyce Henry Lauren Douglas Kelly Peter Christina "
    "Zachary Joan Kyle Evelyn Noah Judith Ethan Andrea Jeremy Hannah Walter Megan Alice Julia Grace Sophie Charlotte Oliver Harry Amelia Oscar Leo Max Lucas Simon Martin Alan Keith Ian Neil "
    "Hans Klaus Jürgen Wolfgang Günter Dieter Horst Uwe Stefan Matthias Andreas Sabine Anja Petra Monika Ursula Birgit Heike Silke Katrin Jens Lars Sven Felix Lukas Jonas Lena Mia Marie Johanna Greta Heinz Karl Otto "
    "Pierre Jean Camille Luc Michel Philippe Alain Bernard Christophe Nicolas Sylvie Isabelle Nathalie Valérie Françoise Monique Chloé Léa Manon Julien Antoine Guillaume Mathieu Hugo Louis Élodie Céline Aurélie René "
    "Carlos Juan Ana Carmen Lucia Lucía Pablo Sofia Sofía Miguel Elena Antonio Manuel Francisco José Javier Jesús Alejandro Fernando Luis Sergio Jorge Alberto Álvaro Raúl Pilar Dolores Isabel Teresa Rosa Cristina Marta Paula Sara Beatriz "
    "Giuseppe Giovanni Marco Luca Francesca Giulia Chiara Wei Ming Li Yuki Hiroshi Kenji Akira Priya Anil Sanjay Rahul Amit Deepak Ravi Mohammed Ahmed Ali Omar Fatima Aisha Ivan Olga Dmitri Natalia Svetlana Igor Piotr Anders Ingrid Erik Astrid".split()
)
#: Lengths of account numbers by country, of the public registry.
COUNTRIES = dict(x.split(":") for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split())
#: Words that begin no name: function words of several languages, days, months.
_NO_NAME = frozenset(
    "The This That These Those There Then They What When Where Which Who Why How And But Or If In On At To Of For From With By As Is Are Was Were It Its He She We You I A An Our Your His Her My New United North South East West "
    "Der Die Das Den Dem Des Ein Eine Einen Einer Und Oder Aber Wenn Ist Sind War Im Am Zu Zum Zur Von Vom Mit Bei Auf Aus Für Nach Es Sie Er Wir Ich Nicht Sich "
    "Le La Les Un Une Des Du De Et Ou Mais Si Est Sont Dans Sur Pour Par Avec Au Aux Il Elle On Nous Vous Je Ce Cette Ces Qui Que En "
    "El Los Las Una Unos Unas Del Y O Pero Es Son Con Por Para Se Al Lo Su Sus Como No "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December License Version Public General Creative".split()
)
_CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write|address|reply)", "card": r"\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)", "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)",
    "ssn": r"\b(?:ssn|social|security)", "phone": r"\b(?:phone|telephone|tel|telefon|teléfono|téléphone|call|dial|mobile|cell|fax|whatsapp|sms|text me|reach)\b", "ip": r"\b(?:ip|host|server|client|from|address)\b",
    "name": r"\b(?:name|dear|signed|regards|sincerely|nombre|nom|contact)\b[ \t]*(?:is|es|est|ist)?[ \t]*[:,]?[ \t\n]*$",
}
_CONTEXT = {k: re.compile(rf"(?i){v}") for k, v in _CONTEXT.items()}
_COUNTER = re.compile(r"(?i)(?:\bversion|\bver\.?|\bv|\bpage|\bsection|\bisbn|\bbuild|\brelease|\border|\bitem|\bno\.?|\b(?:19|20)\d\d|[$€£=\"])\s?$")
_DATE = re.compile(r"(?:19|20)\d\d[ .\-](?:0?[1-9]|1[0-2])[ .\-](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[ .\-](?:0?[1-9]|[12]\d|3[01])[ .\-](?:19|20)\d\d")
SPAN = "struct<start: int, end: int, kind: int, votes: array<int>, feats: array<int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _votes(text: str, start: int, end: int, kind: str, names: frozenset[str]) -> list[int]:
    s = text[start:end]
    digits = re.sub(r"\D", "", s)
    before, after = text[max(0, start - 40) : start], text[end : end + 2]
    votes = dict.fromkeys(LABELERS, 0)
    # a number that goes on in either direction, or by its own kind of separator, is part of another one
    own = re.search(r"(?<=\d)[ .\-](?=\d)", s)
    sep = re.escape(own.group()) if own else "-"
    joined = bool(re.search(rf"[\w/#][\-.]?$|\d{sep}$", before[-2:])) or bool(re.match(rf"[\-/]?\w|{sep}\d", after))
    if kind == "email":
        votes["strict"] = 1 if _EMAIL.fullmatch(s) else -1
        votes["gazetteer"] = 1 if s.rsplit(".", 1)[-1].lower() in TLDS else -1
        votes["valid"] = -1 if ".." in s or s[0] in ".-" or "." not in s.rsplit("@", 1)[1] else 1
    elif kind == "card":
        votes["strict"] = -1 if joined else 1
        votes["valid"] = 1 if luhn(digits) else 0
        votes["gazetteer"] = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif kind == "iban":
        votes["strict"] = 1 if _iban_ok(s) else -1
        length = COUNTRIES.get(s[:2])
        votes["gazetteer"] = 1 if length else -1
        votes["valid"] = 1 if length and len(s.replace(" ", "")) == int(length) else -1
    elif kind == "ssn":
        votes["strict"] = -1 if joined or s.isdigit() else 1 if "-" in s else 0
        good = not (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000")
        votes["valid"] = -1 if not good else 0 if s.isdigit() else 1
    elif kind == "phone":
        other = _DATE.fullmatch(s) or _IP.fullmatch(s) or _SSN.fullmatch(s) and not s.isdigit()
        shaped = not s.isdigit() and not joined and not other
        votes["strict"] = 1 if shaped and (s[0] in "+(" or re.search(r"\d{3,4}[ .\-]\d{4}$|^0\d", s)) else -1
        votes["valid"] = -1 if other or not 7 <= len(digits) <= 15 else 1 if shaped and len(digits) >= 8 else 0
        votes["gazetteer"] = 1 if s.startswith(("+", "(", "00")) else 0
    elif kind == "ip":
        octets = s.split(".")
        numbers = [int(x) for x in octets]
        votes["strict"] = 1 if max(numbers) <= 255 and not joined else -1
        votes["valid"] = 1 if 0 < numbers[0] < 224 and not any(len(x) > 1 and x[0] == "0" for x in octets) else -1
        votes["gazetteer"] = -1 if numbers[0] in (0, 127, 255) or numbers == [numbers[0]] * 4 or max(numbers) < 10 else 0
    else:
        first, last = s.split(" ")
        votes["strict"] = 1 if _TITLE.search(before) else 0
        votes["gazetteer"] = 1 if first in names else -1 if first in _NO_NAME or last in _NO_NAME or first in _TITLES else 0
        votes["valid"] = -1 if len(first) < 2 or len(last) < 2 or s.isupper() else 0
    votes["context"] = 1 if _CONTEXT[kind].search(before) else 0
    votes["counter"] = -1 if _COUNTER.search(before[-12:]) else 0
    return [votes[x] for x in LABELERS]


def candidates(text: str | None, names: frozenset[str] = FIRST_NAMES) -> list[tuple[int, int, int, list[int], list[int]]]:
    """``(start, end, kind, votes, features)`` of whatever any labeler votes for, ascending; they may overlap."""
    if not text:
        return []
    found: set[tuple[int, int, str]] = set()
    if "@" in text:
        for m in _AT.finditer(text):
            found.add((m.start(), m.start() + len(m.group().rstrip(".-_")), "email"))
    for zone in _ZONE.finditer(text):
        for kind, pattern in (("card", _CARD), ("ssn", _SSN), ("ip", _IP), ("phone", _PHONE)):
            at = zone.start()
            while m := pattern.search(text, at, zone.end()):
                found.add((m.start(), m.end(), kind))
                # a reading may begin at any later number of the stretch
                at = m.start() + 1
                while at < zone.end() and text[at].isdigit():
                    at += 1
    found.update((m.start(), m.end(), "iban") for m in _IBAN.finditer(text))
    found.update((m.start(1), m.end(2), "name") for m in _PAIR.finditer(text))
    out = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], x[1], KINDS.index(x[2]))):
        votes = _votes(text, a, b, kind, names)
        if max(votes) <= 0:
            continue
        s = text[a:b]
        around = text[max(0, a - 1) : a] + text[b : b + 1]
        feats = [min(3, sum(c.isdigit() for c in s) // 5), min(3, (b - a) // 8), int(around.strip(" \n\t.,;:!?()[]<>\"'") == ""), int(s.isdigit())]
        out.append((a, b, KINDS.index(kind), votes, feats))
    return out


def without_overlaps(spans: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Of ``(probability, start, end, kind)`` those that stay, ascending."""
    starts: list[int] = []
    taken: list[tuple[float, int, int, int]] = []
    for x in sorted(spans, key=lambda x: (-x[0], x[1] - x[2], x[3], x[1])):
        i = bisect_left(starts, x[1])
        if (i == 0 or taken[i - 1][2] <= x[1]) and (i == len(taken) or taken[i][1] >= x[2]):
            starts.insert(i, x[1])
            taken.insert(i, x)
    return taken


def read_names(spark: SparkSession, path: str) -> frozenset[str]:
    """First names of a file of one a line, for the gazetteer; over ``MOST_NAMES`` is an error, as they are broadcast."""
    rows = spark.read.text(path).where("trim(value) <> ''").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names in {path}")
    return frozenset(r.value.strip() for r in rows)


def estimate(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: probability of each pattern, and each kind's labeler reliabilities.

    A labeler that votes is right with probability ``reliability[kind, labeler]``, for either class, with the Beta prior ``PRIOR``.
    """
    a, b = PRIOR
    reliability = np.full((len(KINDS), len(LABELERS)), a / (a + b))
    rate = np.full(len(KINDS), 0.5)
    p = np.full(len(kinds), 0.5)
    for _ in range(rounds):
        weight = np.log(reliability / (1 - reliability))[kinds]
        logit = (votes * weight).sum(1) + np.log(rate / (1 - rate))[kinds]
        new = 1 / (1 + np.exp(-logit))
        for k in range(len(KINDS)):
            mine = kinds == k
            if not mine.any():
                continue
            n, q, v = counts[mine][:, None], new[mine][:, None], votes[mine]
            right = (n * np.where(v > 0, q, np.where(v < 0, 1 - q, 0))).sum(0)
            voted = (n * (v != 0)).sum(0)
            # the prior weighs a hundredth of the votes, so one kind's monoculture can't turn a labeler round
            scale = 1 + voted / 100
            reliability[k] = np.clip((right + scale * a) / (voted + scale * (a + b)), 0.05, 0.99)
            rate[k] = np.clip((float((n * q).sum()) + 1) / (float(n.sum()) + 2), 0.05, 0.95)
        if np.abs(new - p).max(initial=0.0) < 1e-9:
            break
        p = new
    return new if len(kinds) else p, reliability


def design(kinds: np.ndarray, votes: np.ndarray, feats: np.ndarray) -> np.ndarray:
    one = np.eye(len(KINDS))[kinds]
    return np.concatenate([one, (one[:, :, None] * votes[:, None, :]).reshape(len(kinds), -1), feats, np.ones((len(kinds), 1))], 1)


def train(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft targets by Newton's method; counts are brought to mean 1."""
    w = np.zeros(x.shape[1])
    n = counts / counts.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - target)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", names: str | None = None) -> DataFrame:
    """``(doc_id, start, end, kind, probability)`` of the spans at or over the threshold; characters from 0, end exclusive.

    ``names``: path of a file of first names for the gazetteer, in place of ``FIRST_NAMES``.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_names(spark, names) if names else FIRST_NAMES)

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(v: pa.Array) -> pa.Array:
        rows = [candidates(t, held.value) for t in v.to_pylist()]
        flat = [s for r in rows for s in r]
        ints = pa.list_(pa.int32())
        kinds = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("votes", ints), ("feats", ints)]
        struct = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
        return list_of(np.fromiter(map(len, rows), np.int64, len(rows)), struct)

    rows = docs.select(col(id_col).alias("doc_id"), spans.asNondeterministic()(col(text_col)).alias("found"))
    rows = materialize(rows.where(F.size("found") > 0), "pii")
    # at most one row for each kind, vote pattern and feature pattern: some thousands, whatever the corpus
    counts = rows.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.feats").agg(F.count("*").alias("n")).collect()
    if not counts:
        return rows.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("probability"))
    counts.sort(key=lambda r: (r.kind, r.votes, r.feats))
    kinds, votes, feats, n = np.array([r.kind for r in counts]), np.array([r.votes for r in counts]), np.array([r.feats for r in counts]), np.array([r.n for r in counts], float)
    target, _ = estimate(kinds, votes, n)
    w = train(design(kinds, votes, feats), target, n)
    p = 1 / (1 + np.exp(-design(kinds, votes, feats) @ w))
    scored = spark.sparkContext.broadcast({(r.kind, *r.votes, *r.feats): float(x) for r, x in zip(counts, p)})

    @F.arrow_udf("array<struct<start: int, end: int, kind: int, probability: double>>")
    def decide(v: pa.Array) -> pa.Array:
        out = []
        for some in v.to_pylist():
            likely = [(scored.value[(s["kind"], *s["votes"], *s["feats"])], s["start"], s["end"], s["kind"]) for s in some]
            out.append(without_overlaps([x for x in likely if x[0] >= threshold]))
        flat = [x for r in out for x in r]
        kinds = [("start", pa.int32(), 1), ("end", pa.int32(), 2), ("kind", pa.int32(), 3), ("probability", pa.float64(), 0)]
        struct = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for _, t, k in kinds], [n for n, _, _ in kinds])
        return list_of(np.fromiter(map(len, out), np.int64, len(out)), struct)

    kept = rows.select("doc_id", F.explode(decide.asNondeterministic()("found")).alias("s"))
    return kept.select("doc_id", "s.start", "s.end", F.array(*[F.lit(k) for k in KINDS])[F.col("s.kind")].alias("kind"), "s.probability")
