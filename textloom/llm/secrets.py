"""Secret scan by assignment-aware lexing.

Source and configuration text is lexed into assignments ``name op value``: ``=``, ``:=``, ``=>``, ``:`` (JSON, YAML, INI,
shell, Python, JavaScript, Go, Java, XML attributes), values quoted in any usual way, bare (configuration), or
concatenated with ``+``, ``.`` or by adjacency; also ``<name>value</name>`` and YAML values that begin on the line after their key. Names that stand in a value (``a``, ``$a``, ``${a}``) are replaced by what
they were last assigned in the document (constant propagation). Each name-literal pair is scored: how sensitive the target
name is, times how much the literal looks like a secret (length, variety, entropy, not a placeholder or path or word).

One pass over the texts; only documents with an assignment sign are lexed. No shuffle.

Defined results: null and empty texts give nothing, as does an empty table. Repeated rows give repeated results. Texts are lexed whole
whatever their length. A literal that reaches several sensitive names is reported once, under the most sensitive (of equals, the first)
name. Redacting keeps all rows and columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, list_of, replace_spans

THRESHOLD, FILLER = 0.5, "[SECRET]"
#: Sensitivity of a target by the words of its name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.95, "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "secret_key": 1.0,
    "private_key": 1.0, "auth_key": 1.0, "encryption_key": 1.0, "signing_key": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.9, "auth": 0.7,
    "connection_string": 0.8, "webhook": 0.6, "key": 0.55, "session": 0.5, "cookie": 0.5, "salt": 0.6, "pass": 0.8, "pin": 0.6,
}
_HARMLESS = {"public", "tokenizer", "tokens", "length", "count", "size", "type", "name", "path", "file", "url", "regex", "max", "min", "num", "id", "field", "label", "primary", "foreign", "sort", "keyboard", "keyword"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\[.*\]|\{\{?.*\}?\}|%\w+%|change.?me|your.*|my.?(?:secret|password|token).*|example.*|sample.*|dummy.*|test(?:ing)?|todo|none|null|nil|undefined|true|false|redacted|placeholder|secret|password|token|string|env(?:iron)?\b.*|os\.(?:environ|getenv).*|process\.env.*|insert.*here)$")
_NAME = r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*(?:\[[\"']?\w+[\"']?\])?"
_ASSIGN = re.compile(
    r"(?P<q>[\"']?)(?<![\w.\-$])(?P<name>" + _NAME + r")(?P=q)\s*+(?::\s{0,2}(?:str|String|string|&str|const char\s?\*)\s{0,4}=|=>|:=|\+?=(?![=>])|:(?!:|//))"
    # a string may begin on a later line or after opening brackets, any other value stands on the operator's line
    r"(?:[\s(\[]*+(?=[rbufRBUF]{0,2}[\"'`])|[ \t]*+)(?=(?P<v>\S))"
)
_STRING = re.compile(r"[rbuf]{0,2}(\"\"\"|'''|\"|'|`)", re.I)
_BARE = re.compile(r"[^\s,;#\"'`<>{}()\[\]]+")
_JOIN = re.compile(r"\s*[+.]\s*|[ \t]+(?=[\"'])")
_REF = re.compile(r"\$\{?(\w+)\}?|\{(\w+)\}")
_IDENT = re.compile(_NAME)
_KEY = re.compile(r"\s*+[:=]")
_ELEMENT = re.compile(r"<(?P<name>" + _NAME + r")(?:\s[^<>]*)?>\s*+(?:<!\[CDATA\[\s*+)?(?P<value>[^<>]+?)\s*(?:\]\]>\s*)?</(?P=name)\s*>")
#: A key whose value is what is indented below it.
_BELOW = re.compile(r"^(?P<lead>[ \t]*(?:-[ \t]+)?)(?P<q>[\"']?)(?P<name>" + _NAME + r")(?P=q)[ \t]*:[ \t]*(?:[|>][+\-\d]*)?[ \t]*(?=\n[ \t]+[^\s#\"'{\[&*!])", re.M)
_NESTED = re.compile(r"(?:-[ \t]+)?[\"']?" + _NAME + r"[\"']?[ \t]*:(?:\s|$)")


def name_score(name: str) -> float:
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    words = [w for w in re.split(r"[^a-z0-9]+", words) if w]
    pairs = ["_".join(words[i : i + 2]) for i in range(len(words) - 1)]
    best = max([SENSITIVE.get(w, 0.0) for w in [*words, *pairs]], default=0.0)
    if words and (words[-1] in _HARMLESS or "public" in words):
        best *= 0.3
    return best


def literal_score(value: str) -> float:
    """From 0 to 1: how much a literal looks like a secret."""
    n = len(value)
    if n < 6 or _PLACEHOLDER.match(value) or re.search(r"\s", value.strip()) and n < 24:
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^\w\s]"))
    if len(counts) < 4:
        return 0.0
    score = min(1.0, entropy / 3.2) * min(1.0, n / 8)
    if classes == 1 and not value.isdigit():
        score *= 0.6
    if "://" in value and "@" not in value or value.startswith(("/", "./")):
        score *= 0.4
    return score


def _string(text: str, at: int):
    """(value, start, end, next) of a string literal that starts at ``at``; an unclosed one ends with its line."""
    m = _STRING.match(text, at)
    if not m:
        return None
    quote, start = m.group(1), m.end()
    i = start
    while True:
        j = text.find(quote, i)
        if j < 0 or len(quote) == 1 and quote != "`" and "\n" in text[i:j]:
            stop = text.find("\n", start)
            stop = stop if stop >= 0 else len(text)
            return text[start:stop], start, stop, stop
        back = 0
        while text[j - 1 - back] == "\\" and j - 1 - back >= start:
            back += 1
        if back % 2 == 0:
            return text[start:j], start, j, j + len(quote)
        i = j + 1


def assignments(text: str):
    """``(name, value, parts)`` of each assignment, in order; parts are where the literals stand that make up the value.

    A part is a span, or the list of parts of a name that stands in the value: lists are shared, so repeated references cost nothing.
    """
    known: dict[str, tuple[str, list]] = {}
    at = 0
    while m := _ASSIGN.search(text, at):
        name, i = m.group("name"), m.end()
        at = i
        values: list[str] = []
        spans: list = []
        bare = None
        while True:
            part = _string(text, i)
            if part:
                literal, start, end, after = part
                if not values and re.search(r"[\n(\[]", m.group()[m.end("name") - m.start() :]) and _KEY.match(text, after):
                    break  # the first key of a nested table
                i = after
                refs, own = [], [(start, end)]
                for r in _REF.finditer(literal):
                    if (k := r.group(1) or r.group(2)) in known:
                        refs.append((r, known[k]))
                pieces, last = [], 0
                for r, (v, _) in refs:
                    pieces += [literal[last : r.start()], v]
                    last = r.end()
                if refs and len(refs[0][0].group()) == len(literal):
                    own = []
                values.append("".join([*pieces, literal[last:]]))
                spans += own + [ss for _, (_, ss) in refs]
            elif ident := _IDENT.match(text, i):
                after = text[ident.end() : ident.end() + 1]
                if ident.group() in known and after not in ("(", "="):
                    v, ss = known[ident.group()]
                    values.append(v)
                    spans.append(ss)
                    i = ident.end()
                elif not values and after != "(":
                    bare = _BARE.match(text, i)
                    break
                else:
                    break
            elif not values and (ref := _REF.match(text, i)) and (ref.group(1) or ref.group(2)) in known:
                v, ss = known[ref.group(1) or ref.group(2)]
                values.append(v)
                spans.append(ss)
                i = ref.end()
            else:
                bare = None if values else _BARE.match(text, i)
                break
            join = _JOIN.match(text, i)
            if not join:
                break
            i = join.end()
        if bare:
            values = [bare.group().rstrip(".,;:!?")]
            spans = [(i, i + len(values[0]))]
            i = bare.end()
        if spans:
            at = max(at, i) if text[m.end() : m.end() + 1] in "\"'`" else at
            value = "".join(values)
            # a self-reference such as x = x + "..." must not grow without bound: what is handed on is scored by its beginning, its parts are whole
            known[name.split(".")[-1]] = known[name] = (value[:4096], spans)
            yield name, value, spans


def block_values(text: str):
    """``(name, value, parts)`` of elements and of keys whose value is indented below them."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield m.group("name"), m.group("value"), [m.span("value")]
    if ":" in text and "\n" in text:
        for m in _BELOW.finditer(text):
            at, spans, deep = m.end() + 1, [], len(m.group("lead"))
            while at <= len(text):
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                body = text[at:end].strip()
                begin = at + len(text[at:end]) - len(text[at:end].lstrip())
                if not body or begin - at <= deep or _NESTED.match(body):
                    break
                if body.startswith("- "):
                    begin, body = begin + 2, body[2:]
                spans.append((begin, begin + len(body)))
                at = end + 1
            if spans:
                yield m.group("name"), "".join(text[a:b] for a, b in spans), spans


def secrets_of(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """``(start, end, name, score)`` of literals that make up values of sensitive names; disjoint, ascending."""
    if not text or "=" not in text and ":" not in text and "</" not in text:
        return []
    best: dict[tuple[int, int], tuple[float, str]] = {}
    seen: dict[int, float] = {}
    held = []  # keeps the lists alive, so that none has another's identity
    for name, value, spans in chain(assignments(text), block_values(text)):
        ns = name_score(name)
        if ns <= 0:
            continue
        score = ns * literal_score(value)
        if score < threshold:
            continue
        held.append(spans)
        todo = [spans]
        while todo:
            parts = todo.pop()
            if seen.get(id(parts), 0.0) >= score:
                continue
            seen[id(parts)] = score
            for s in parts:
                if isinstance(s, list):
                    todo.append(s)
                elif s[1] - s[0] >= 4 and (s not in best or best[s][0] < score):
                    best[s] = (score, name)
    out: list[tuple[int, int, str, float]] = []
    for (a, b), (score, name) in sorted(best.items()):
        if out and a < out[-1][1]:
            p = out[-1]
            out[-1] = (p[0], max(b, p[1]), p[2], max(p[3], score))
        else:
            out.append((a, b, name, score))
    return out


def secret_column(text: Column, threshold: float = THRESHOLD) -> Column:
    @F.arrow_udf("array<struct<start: int, end: int, name: string, score: double>>")
    def secrets(v: pa.Array) -> pa.Array:
        rows = [secrets_of(t, threshold) for t in v.to_pylist()]
        flat = [s for r in rows for s in r]
        kinds = [("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]
        struct = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
        return list_of(np.fromiter(map(len, rows), np.int64, len(rows)), struct)

    return secrets.asNondeterministic()(text)


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, name, score)``: character span of each secret literal from 0, end exclusive."""
    rows = docs.select(col(id_col).alias("doc_id"), secret_column(col(text_col), threshold).alias("found"))
    return rows.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.start", "s.end", "s.name", "s.score")


def redact_secrets(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", length_col: str | None = "n_chars", filler: str = FILLER) -> DataFrame:
    """All documents and columns, each secret literal replaced by the filler; the length column follows the text."""
    found, cut = fresh(docs, "found", "cut")
    # the new text is a column of its own first: beside an alias `text`, lambdas would read the alias for the column
    out = docs.withColumn(found, secret_column(col(text_col), threshold)).withColumn(cut, replace_spans(col(text_col), col(found), filler))
    new = {text_col: col(cut)}
    if length_col in docs.columns:
        new[length_col] = F.when(F.size(col(found)) > 0, F.length(col(cut)).cast(docs.schema[length_col].dataType)).otherwise(col(length_col))
    return out.select(*[new.get(c, col(c)).alias(c) for c in docs.columns])
