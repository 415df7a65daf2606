"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule names a measure and the bounds it has to keep to. Measures are native expressions over the whole text:
counts by regular expression or ``translate``, and ratios of them. Compiling gives one column a rule and their conjunction.

Defined results: measures of a null text are those of the empty text; ratios over nothing are 0. A bound of null is no bound; a measure that
equals a bound keeps to it. Every row is measured by itself: repeated rows give repeated results, an empty table gives none. Texts are
measured whole whatever their length. Extra columns stay, whatever their names.
Short texts of no stop word at all are common, so the stop-word bound holds from 30 words on.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les ou par pas pour qui que se sur un une "
    "al como con del el es esta la las los no para por se su sus una y "
    "an auf aus bei das dem den der des die ein eine er es ist mit nicht sich sie und von zu"
)


class Where(NamedTuple):
    """A bound that is ``value`` where ``measure`` is at least ``least``, else ``other``."""

    measure: str
    least: float
    value: float
    other: float

    def of(self, m: Column) -> Column:
        return F.when(m[self.measure] >= F.lit(self.least), F.lit(self.value)).otherwise(F.lit(self.other))

    def __str__(self) -> str:
        return f"CASE WHEN {self.measure} >= {self.least} THEN {self.value} ELSE {self.other} END"


#: measure, least, most; bounds are numbers or ``Where``
RULES = [
    ("n_words", 1, 100_000),
    ("mean_word_length", 1.0, 14.0),
    ("symbol_word_ratio", None, 0.2),
    ("stop_word_ratio", Where("n_words", 30, 0.05, 0.0), None),
    ("upper_ratio", None, 0.5),
    ("bar_ratio", None, 0.1),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
    ("digit_ratio", None, 0.5),
    ("unique_word_ratio", 0.12, None),
]
_SYMBOLS, _MARKS = r"[#$%&*@^~<>{}\[\]\\=+_]", ".,;:!?"


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """Lower-cased runs of non-space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\S+"), F.lit(0))


def measures(text: Column, w: Column) -> dict[str, Column]:
    """Of a text and its ``words``."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    n_words, n_lines = F.size(w).cast("long"), count(r"\n") + 1
    letters = F.length(F.array_join(w, "")).cast("long")
    stop = sorted(set(STOP_WORDS.split()))
    return {
        "n_words": n_words,
        "mean_word_length": _ratio(letters, n_words),
        "symbol_word_ratio": _ratio(count(_SYMBOLS), n_words),
        "stop_word_ratio": _ratio(F.size(F.filter(w, lambda x: F.rtrim(x, F.lit(_MARKS)).isin(*stop))), n_words),
        "upper_ratio": _ratio(count("[A-Z]"), letters),
        "bar_ratio": _ratio(count(r"\|"), n_words),
        "bullet_line_ratio": _ratio(count(r"(?:^|\n)[ \t]*[-*•]"), n_lines),
        "ellipsis_line_ratio": _ratio(count(r"(?:\.\.\.|…)[ \t]*(?:\n|$)"), n_lines),
        "digit_ratio": _ratio(count("[0-9]"), letters),
        "unique_word_ratio": F.when(n_words > 0, F.size(F.array_distinct(w)) / n_words).otherwise(F.lit(1.0)),
    }


def compile_rules(rules=RULES):
    """The table as a function from a text and its words to one struct of measures, and the condition on that struct to keep the text."""

    def measure(text: Column, w: Column) -> Column:
        known = measures(text, w)
        return F.struct(*[known[n].alias(n) for n, _, _ in rules])

    def bound(x, m: Column) -> Column:
        return x.of(m) if isinstance(x, Where) else F.lit(x)

    def keep(m: Column) -> Column:
        out = F.lit(True)
        for n, least, most in rules:
            if least is not None:
                out = out & (m[n] >= bound(least, m))
            if most is not None:
                out = out & (m[n] <= bound(most, m))
        return out

    return measure, keep


def _with_measures(docs: DataFrame, rules, text_col: str, name: str) -> DataFrame:
    """Adds the struct of measures.

    The one-element explode stands between the measures and any filter on them: the optimizer would else push the
    filter below the projection and compute every measure twice.
    """
    (w,) = fresh(docs, "w")
    measure, _ = compile_rules(rules)
    out = docs.withColumn(w, words(col(text_col))).withColumn(name, measure(col(text_col), col(w))).drop(w)
    return out.select(*[col(c) for c in docs.columns], F.explode_outer(F.array(col(name))).alias(name))


def measured(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, every measure and ``keep``, for every document."""
    some = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    out = _with_measures(some, rules, "text", "m")
    return out.select("doc_id", "m.*", compile_rules(rules)[1](F.col("m")).alias("keep"))


def filter_documents(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents that keep to every bound, with all their columns."""
    (m,) = fresh(docs, "m")
    return _with_measures(docs, rules, text_col, m).where(compile_rules(rules)[1](col(m))).drop(m)


def oracle(rules=RULES) -> str:
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS.split())))
    n, letters, lines = "len(w)", "length(array_to_string(w, ''))", "(" + count(r"\n") + " + 1)"
    sql = {
        "n_words": f"CAST({n} AS BIGINT)", "mean_word_length": ratio(letters, n), "symbol_word_ratio": ratio(count(_SYMBOLS), n),
        "stop_word_ratio": ratio(f"len(list_filter(w, lambda x: rtrim(x, '{_MARKS}') IN ({stop})))", n), "upper_ratio": ratio(count("[A-Z]"), letters), "bar_ratio": ratio(count(r"\|"), n),
        "bullet_line_ratio": ratio(count(r"(?:^|\n)[ \t]*[-*•]"), lines), "ellipsis_line_ratio": ratio(count(r"(?:\.\.\.|…)[ \t]*(?:\n|$)"), lines),
        "digit_ratio": ratio(count("[0-9]"), letters), "unique_word_ratio": f"CASE WHEN {n} > 0 THEN CAST(len(list_distinct(w)) AS DOUBLE) / {n} ELSE 1.0 END",
    }
    cols = ", ".join(f"{sql[k]} AS {k}" for k, _, _ in rules)
    bounds = " AND ".join([f"{k} >= {a}" for k, a, _ in rules if a is not None] + [f"{k} <= {b}" for k, _, b in rules if b is not None])
    return rf"WITH m AS (SELECT doc_id, {cols} FROM (SELECT doc_id, t, regexp_extract_all(lower(t), '\S+') AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))) SELECT * FROM m WHERE {bounds}"
