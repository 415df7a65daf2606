"""Operators on small hand-made inputs."""

import gzip
import re
import struct
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import columns as C
from textloom.functions import language as L
from textloom.functions import tokenizer as T
from textloom.operators import crf, dataset, forge, indexing, metrics, models, ner, rules, running, spans, train
from textloom.operators import reduce as R
from textloom.plans.engines import GRAPH
from textloom.plans.graph import TransformGraph
from textloom.sources import io, store
from textloom.streaming import score


def pairs(text, mode="PlainText"):
    return [(c, t) for c, t, _ in T.tokenize(text, mode)]


@given(st.text(alphabet="aB1 .,<>/&;:-'\"\n\ré\U0001f600漢!?=[]", max_size=60), st.sampled_from(["PlainText", "HTML", "XML"]))
@settings(max_examples=300, deadline=None)
def test_tokens_cover_the_text(text, mode):
    tokens = T.tokenize(text, mode)
    assert "".join(c for c, _, _ in tokens) == text
    at = 0
    for c, _, o in tokens:
        assert c and o == at
        at += len(c)


def test_tokens():
    assert pairs("Can't stop.") == [("Can't", "Word"), (" ", "Whitespace"), ("stop", "Word"), (".", "Punctuation")]
    assert pairs("a  b\r\nc") == [("a", "Word"), (" ", "Whitespace"), (" ", "Whitespace"), ("b", "Word"), ("\r\n", "Whitespace"), ("c", "Word")]
    assert ("http://x.org/a?b=1", "URI") in pairs("see http://x.org/a?b=1, ok")
    assert ("mailto:me@x.org", "URI") in pairs("mailto:me@x.org.") and ("http://x.org/", "URI") in pairs("(http://x.org/)")
    assert (":-)", "Word") in pairs("fine :-) yes") and ("&amp;", "Word") in pairs("a &amp; b") and ("&#38;", "Word") in pairs("&#38;") and ("&#9999999;", "Word") not in pairs("&#9999999;")
    assert pairs("漢字") == [("漢", "Word"), ("字", "Word")]
    assert pairs("<p>a</p>", "HTML") == [("<p>", "Markup"), ("a", "Word"), ("</p>", "Markup")]
    assert pairs('<script a="b">x<1</script>y', "HTML") == [('<script a="b">x<1</script>', "Markup"), ("y", "Word")]
    assert pairs("<script/>y", "HTML") == [("<script/>", "Markup"), ("y", "Word")]
    assert pairs("<a><![CDATA[b c]]></a>", "XML") == [("<a>", "Markup"), ("<![CDATA[", "Markup"), ("b", "Word"), (" ", "Whitespace"), ("c", "Word"), ("]]>", "Markup"), ("</a>", "Markup")]
    assert pairs('<!DOCTYPE a [<!ELEMENT a ANY>]><!-- x --><?pi y?>', "XML") == [("<!DOCTYPE a [<!ELEMENT a ANY>]>", "Markup"), ("<!-- x -->", "Markup"), ("<?pi y?>", "Markup")]
    assert T.tokenize(None) == [] and T.tokenize("") == []


def test_tokens_by_parts(monkeypatch):
    """Of a batch only some texts' tokens are Python objects at once, and the result is the whole batch's."""
    texts, held = ["one two", None, "", "<b>x</b> &amp; " * 20, "three", "4 five"] * 3, []
    monkeypatch.setattr(T.F, "arrow_udf", lambda kind: lambda f: SimpleNamespace(asNondeterministic=lambda: lambda *columns: f))
    columns = T._columns
    monkeypatch.setattr(T, "_columns", lambda rows: held.append(sum(len(c) for r in rows for c, _, _ in r)) or columns(rows))
    monkeypatch.setattr(T, "CHUNK_CHARS", 20)
    modes = pa.array(["HTML"] * len(texts))
    for make in (T.tokens, T.marks):
        found = make(None, None)(pa.array(texts), modes).to_pylist()
        want = [T.tokenize(t, "HTML") for t in texts]
        assert [[(m["offset"], m["length"]) for m in row] for row in found] == [[(o, len(c)) for c, _, o in row] for row in want]
    assert len(held) > 10 and all(n <= 20 or n == len(texts[3]) for n in held)
    assert make(None, None)(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_nested_sections():
    """Conditional sections and internal subsets are one token each, whatever is nested in them; unclosed ones are text."""
    marks = lambda t: [c for c, k, _ in T.tokenize(t, "XML") if k == "Markup"]
    section = "<![%x; [<!ENTITY t 'IGNORE ]]>'> <![INCLUDE[ a <!-- ]]> --> ]]> ]]>"
    assert marks(f"{section}hello!\n<![%bar; []]>") == [section, "<![%bar; []]>"]
    dtd = "<!DOCTYPE complex [\n<!-- comments <![ here -->\n%this;\n<!ELEMENT foo>\n<![%that; [ <![%this; [ <!ATTLIST bar> ]]> ]]>\n<?pi ]> ?>\n]\n>"
    assert marks(f'{dtd}<foo bar="baz">hi</foo>') == [dtd, '<foo bar="baz">', "</foo>"]
    assert marks('<!DOCTYPE html PUBLIC "a" "b"><doc/>') == ['<!DOCTYPE html PUBLIC "a" "b">', "<doc/>"]
    for text in ("<![x[ <b>", "<!DOCTYPE a [ <!ELEMENT b>", "<!DOCTYPE a"):
        assert "".join(c for c, *_ in T.tokenize(text, "XML")) == text
    assert marks("<![x[ <b> c") == ["<b>"]


def test_sniff():
    cases = {"<p>x</p>": "HTML", "<a><b/></a>": "XML", "<?xml?>": "XML", "<![CDATA[x]]>": "XML", "<!-- c -->": "XML", "<!-- c --><br>": "HTML", "<!ELEMENT>": "PlainText", "a < b": "PlainText", "<1>": "PlainText", "<a": "PlainText", "plain": None, None: None}
    for text, want in cases.items():
        assert T.sniff(text) == want, text


def test_columns(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], "Hello-42 WORLD"), ([], ""), (["x"], None)], "w array<string>, t string")
    r = df.select(
        F.transform(C.ngrams(F.col("w"), 2, 3), C.display).alias("n"), F.transform(C.skipgrams(F.col("w"), 1, 2), C.display).alias("s"), C.word_shape(F.col("t")).alias("p"), C.chain_neighborhood(F.col("w"), 1, 2).alias("h"),
    ).collect()
    assert r[0].n == ["a b c", "b c d", "a b", "b c", "c d"] and r[1].n == [] and r[2].n == []
    assert sorted(r[0].s) == ["a b", "a c", "b c", "b d", "c d"] and r[0].p == "CccpnnsCC"
    assert [[(x.offset, x.feature) for x in link] for link in r[0].h][1] == [(-1, "a"), (1, "c"), (2, "d")] and r[1].h == []
    with pytest.raises(ValueError):
        C.chain_neighborhood(F.col("w"), 128, 0)
    lang = spark.createDataFrame([("en-US",), ("DEU",), ("xx",), (None,)], "c string").select(C.normalize_language(F.col("c")).alias("l")).collect()
    assert [x.l for x in lang] == ["eng", "deu", None, None]
    t = spark.createDataFrame([("a\U0001f600b", 1, 2), ("abc", 9, 1), ("abc", -1, 2), ("abc", 1, 99), ("abc", 0, 0)], "t string, o int, n int")
    o, n = C.to_utf16(F.col("t"), F.col("o"), F.col("n"))
    assert [(x.o2, x.n2) for x in t.select(o.alias("o2"), n.alias("n2")).collect()] == [(1, 3), (0, 0), (0, 1), (1, 2), (0, 0)]


def test_offsets_out_of_bounds(spark):
    """The reference's cases of spans beyond a text, both ways."""
    cases = {(19, 1): (19, 0), (1, 19): (1, 18), (-5, 5): (0, 0), (-1, 8): (0, 7), (16, 4): (16, 3), (-10, 100): (0, 19), (0, -1): (0, 0), (20, 1): (0, 0)}
    df = spark.createDataFrame(list(cases), "o int, n int").withColumn("t", F.lit("This is a document."))
    for convert in (C.to_utf16, C.from_utf16):
        o, n = convert(F.col("t"), F.col("o"), F.col("n"))
        assert {(r.o, r.n): (r.o2, r.n2) for r in df.select("o", "n", o.alias("o2"), n.alias("n2")).collect()} == cases


def test_running(spark):
    rows = [(i * i % 37, i) for i in range(200)] + [(None, 500)]
    df = running.row_numbers(spark.createDataFrame(rows, "k long, i long"), "k", ["i"], "row", buckets=7)
    got = [(r.k, r.i) for r in df.orderBy("row").collect()]
    assert got == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) and [r.row for r in df.orderBy("row").collect()] == list(range(1, 202))


def test_running_tfidf_in_few_ranges(spark, monkeypatch):
    """Ranges follow the documents a word can be in, not all words' rows: one range writes nothing; wide rows have more ranges."""
    counts = spark.range(40).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("dim"), F.lit(2).alias("tf"))
    docs, asked = spark.range(40).select(F.col("id").alias("doc_id")), []
    plain = running._bucketed
    monkeypatch.setattr(running, "_bucketed", lambda df, order, n: asked.append(n) or plain(df, order, n))
    monkeypatch.setattr(running, "RANGE_ROWS", 10)
    for rows, ranges in ((50, []), (10, [4])):
        monkeypatch.setattr(indexing, "RANGE_ROWS", rows)
        asked.clear()
        got = indexing.tfidf_running(counts, docs).collect()
        assert [n for n in asked if n is not None] == ranges and len(got) == 400 and all(abs(r.value) < 1e-12 for r in got)
    monkeypatch.setattr(running, "RANGE_BYTES", 1000)
    wide = running.materialize(spark.range(5).select("id", F.expr("repeat(uuid(), 100)").alias("text")), "wide")
    assert running._ranges(wide) > 3


def test_vocabulary(spark):
    feats = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "c"), (2, 1, "b"), (3, 0, "c"), (3, 1, "d")], "doc_id long, pos int, feature string")
    assert [(r.dim, r.feature, r.n_obs) for r in indexing.build_vocabulary(feats, 2).orderBy("dim").collect()] == [(0, "a", 2), (1, "b", 2), (2, "c", 2)]
    assert [r.feature for r in indexing.build_vocabulary(feats, 0).orderBy("dim").collect()] == ["a", "b", "c", "d"]


def test_counts_in_rows(spark, monkeypatch):
    """Counted in rows and by parts of a batch, words are those that grouping finds, also where ids repeat; they are shuffled once, by word."""
    rows = [(1, ["b", "a", "b", None, ""]), (2, []), (3, None), (1, ["b", "c"]), (4, ["a"] * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, w array<string>")
    monkeypatch.setattr(indexing, "COUNT_TOKENS", 4)
    got = indexing.array_counts(docs, "w")
    want = indexing.features(docs, "w").groupBy("doc_id", "feature").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    vocabulary = spark.createDataFrame([(0, "a"), (1, "b")], "dim int, feature string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = got.join(vocabulary.hint("merge"), "feature")
    assert plan(joined).count("Exchange hashpartitioning(feature") + plan(joined).count("Exchange hashpartitioning(doc_id") <= 2
    chain = indexing.chain_term_counts(indexing.features(docs, "w"), vocabulary.hint("merge"))
    assert "hashpartitioning(doc_id" not in plan(chain)


def test_rules(spark):
    docs = spark.createDataFrame([(1, "Good good bad"), (2, "ugly"), (3, None)], "doc_id long, text string")
    m = rules.document_rule_matches(docs, [("x", "good", 0.8), ("x", "/b.d/", 0.0), ("x", "/(/", 0.5), ("x", "u", 2.0)])
    got = {(r.doc_id, r.label): r for r in rules.document_rule_scores(m).collect()}
    assert set(got) == {(1, "x")} and got[1, "x"].probability == 0 and got[1, "x"].flags == 3 and got[1, "x"].match_count == 1
    many = [("x", "good", 0.5)] * (rules.UNROLL + 1)
    assert rules.document_rule_matches(docs, many).count() == rules.UNROLL + 1
    s = rules.span_rule_matches(docs, [("thing", "/is (?<thing>g..d)|(?<thing2>bad)/", 0.7), ("w", "good", 1.0), ("slow", "/(a+)+$/", 0.5)]).collect()
    assert sorted((r.label, r.offset, r.length, r.flags) for r in s) == [("w", 0, 4, 3), ("w", 5, 4, 3)]


def span(label, p, o, n, flags=2):
    return {"label": label, "probability": p, "flags": flags, "offset": o, "length": n}


def test_risky_rules(spark):
    """Patterns that backtrack without end are matched all the same, in linear time, with the same matches as elsewhere."""
    import time

    import regex

    from textloom.operators import rules

    assert [rules.risky(e) for e in ("/(a+)+b/", "/(?:a|b)*c/", "/a+b/", "/[0-9]+(\\.[0-9]+)?/", "the", "/(\\w+ ?)+!/", "/[(a+)+]b/")] == [True, True, False, False, False, True, False]
    for pattern, text in (("(a+)+b", "aaa b aab! ünï aab" * 3), (r"(?:\ba|b)+", "\na\nba ab\n"), (r"(?i)(ab?)+", "AB abab ß ab"), (r"(x*y?)+z", "xxyxz z yz")):
        assert rules.linear_spans(text, pattern, 0) == [m.span() for m in regex.finditer(pattern, text, regex.ASCII) if m.group()]
    assert rules.linear_spans("foo bar! x baz!", r"(?P<w>(\w+ ?)+)!", "w") == [(0, 7), (9, 14)]
    bad = [("x", "/(a+)+b/", 0.5), ("y", "a", 1.0)]
    docs = spark.createDataFrame([(1, "a" * 5000), (2, "aab"), (3, None)], "doc_id long, text string")
    start = time.time()
    got = {(r.doc_id, r.label): r.n for r in rules.document_rule_matches(docs, bad).collect()}
    assert got == {(1, "y"): 5000, (2, "x"): 1, (2, "y"): 2}
    assert {(r.doc_id, r.offset, r.length) for r in rules.span_rule_matches(docs, bad[:1]).collect()} == {(2, 0, 3)} and time.time() - start < 60


def test_many_rules(spark, monkeypatch):
    """More rules than a projection holds are several projections, not a join with all documents."""
    from textloom.operators import rules

    some = [("x", w, 0.5) for w in ("a", "b", "/c+/", "d", "zz")]
    docs = spark.createDataFrame([(1, "a b cc d"), (2, "zz")], "doc_id long, text string")
    want = sorted(map(tuple, rules.document_rule_matches(docs, some).collect()))
    monkeypatch.setattr(rules, "UNROLL", 2)
    many = rules.document_rule_matches(docs, some)
    assert sorted(map(tuple, many.collect())) == want and len(want) == 5
    assert "Join" not in many._jdf.queryExecution().executedPlan().toString()


def test_numbered_group(spark):
    from textloom.operators import rules

    docs = spark.createDataFrame([(1, "no 17 of 17"), (2, "17")], "doc_id long, text string")
    got = {(r.doc_id, r.offset, r.length) for r in rules.span_rule_matches(docs, [("n", "/(17) of (?<n>17)/", 0.5)]).collect()}
    assert got == {(1, 3, 2)}


def test_running_on_crowded_values(spark):
    """Ranges by quantiles: crowded and repeated values, nulls, ties and structs."""
    from pyspark.sql import functions as F

    from textloom.operators import running

    rows = [(x, i) for i, x in enumerate([None, None, 5.0, 5.0, -1e9, 3.0, 1e12] + [k / 1000 for k in range(3000)] + [0.5] * 700)]
    df = spark.createDataFrame(rows, "x double, i long")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for buckets in (1, 3, 16):
        got = {r.i: r.row for r in running.row_numbers(df, "x", ["i"], "row", buckets).collect()}
        assert got == {i: k for k, (_, i) in enumerate(order, 1)}
    got = {r.i: tuple(r.s) for r in running.running_sum(df.where("i < 50"), F.struct(F.lit(1).alias("a"), F.col("i").alias("b")), "x", ["i"], [], "s", 4, sums=("a", "b")).collect()}
    total = 0
    for k, (_, i) in enumerate([r for r in order if r[1] < 50], 1):
        total += i
        assert got[i] == (k, total)
    assert running.row_numbers(df.limit(0), "x").count() == 0


def test_span_folds(spark):
    a, b, c = span("a", 0.9, 0, 5), span("b", 0.6, 3, 5), span("c", 0.7, 9, 2)
    assert spans.greedy([c, b, a]) == [a, c]
    assert spans.greedy([span("b", 0.6, 0, 5), span("a", 0.4, 0, 5)])[0]["label"] == "a"
    assert spans.reduce_rule_spans([a, c]) == [a, c]
    merged = spans.reduce_rule_spans([span("a", 0.8, 0, 5), span("a", 0.6, 3, 5), c])
    assert merged[0]["length"] == 8 and merged[0]["probability"] == pytest.approx(0.7)
    assert spans.reduce_ensemble([span("m", 0.99, 0, 9, 0), span("r", 0.6, 2, 2)]) == [span("r", 0.6, 2, 2)]
    assert spans.reduce_ensemble([span("r", 0.2, 2, 2)]) == []
    with pytest.raises(ValueError):
        spans.reduce_ensemble([span("m", 0.9, 0, 5, 0), span("m", 0.9, 3, 5, 0)])
    df = spark.createDataFrame([(1, *a.values()), (1, *b.values()), (2, *c.values())], "doc_id long, label string, probability double, flags int, offset int, length int")
    assert {(r.doc_id, r.label) for r in spans.reduce_spans(df, "greedy").collect()} == {(1, "a"), (2, "c")}


def test_folds_by_parts(spark, monkeypatch):
    """Of a batch of documents' spans some are Python objects at once; lists stay whole, also empty batches work."""
    v = pa.array([[1] * n for n in (5, 0, 30, 1, 1, 9, 9, 2)])
    monkeypatch.setattr(spans, "FOLD_SPANS", 10)
    parts = [p.to_pylist() for p in spans._parts(v)]
    assert [x for p in parts for x in p] == v.to_pylist() and all(len(p) == 1 or sum(map(len, p)) <= 10 for p in parts)
    assert [p.to_pylist() for p in spans._parts(v.slice(0, 0))] == [[]]
    docs = spark.createDataFrame([(1, "the 12 then"), (2, None), (3, "")], "doc_id long, text string")
    found = rules.span_rule_matches(docs, [("number", "/(?<number>[0-9]+)/", 0.8), ("t", "/th[a-z]+/", 1.0)]).collect()
    assert sorted((r.doc_id, r.label, r.probability, r.flags, r.offset, r.length) for r in found) == [(1, "number", 0.8, 2, 4, 2), (1, "t", 1.0, 3, 0, 3), (1, "t", 1.0, 3, 7, 4)]


def test_gang(spark):
    rows = [(1, "x", 0.8, 1, 0), (1, "x", 0.6, 1, 2), (2, "x", 0.9, 1, 0), (2, "x", 0.0, 2, 3), (3, "x", 0.5, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, label string, probability double, match_count long, flags int")
    got = {r.doc_id: r for r in R.gang_reduce(df).collect()}
    assert got[1].probability == pytest.approx(2 * 0.48 / 1.4) and got[1].match_count == 2 and got[1].flags == 2
    assert got[2].probability == 0 and got[2].flags == 3 and got[3].probability == 0


def test_dataset(spark):
    one = spark.createDataFrame([(i, 1.0) for i in range(5)], "doc_id long, y double")
    assert sorted(r.y for r in dataset.ensure_two_classes(one).collect()) == [0.0] * 5 + [1.0] * 5
    with pytest.raises(ValueError):
        dataset.ensure_two_classes(one.where("false"))
    two = spark.createDataFrame([(i, float(i % 10 == 0)) for i in range(1000)], "doc_id long, y double")
    n = dataset.balance_binary(two).where("y = 0").count()
    assert 70 < n < 135
    folds = dataset.with_shuffled_fold(one, 2).collect()
    assert {r.fold for r in folds} == {0}
    sizes = [r["count"] for r in dataset.with_shuffled_fold(two, 4).groupBy("fold").count().collect()]
    assert sizes == [250] * 4
    assert dataset.dealt_folds(10, 3, 1) == [0, 0, 1, 2, 1, 2, 0, 0, 1, 2]
    dealt = dataset.with_dealt_fold(two.limit(20), 3).orderBy("doc_id").collect()
    assert [r.fold for r in dealt] == dataset.dealt_folds(20, 3)


def test_crf(spark):
    """Two toy sequences are learned and decoded."""
    seqs = [([[0], [1], [2], [3], [1]], ["O", "BX", "IX", "O", "BX"]), ([[1], [2], [2], [0], [3]], ["BX", "IX", "IX", "O", "O"])]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(seqs)], "doc_id long, features array<array<int>>, tags array<string>")
    m = crf.train(df, 4, ["O", "BX", "IX"])
    assert all([t for t, _ in m.decode(x)] == y for x, y in seqs) and m.decode([]) == []
    out = df.select(crf.decode(df, F.col("features"), m).alias("p")).collect()
    assert [x.tag for x in out[0].p] == seqs[0][1] and all(0 <= x.confidence <= 1 for x in out[0].p)
    g = np.random.default_rng(0)
    m.obs, m.trans = g.normal(size=m.obs.shape), g.normal(size=m.trans.shape)
    import itertools

    x = [[0], [1], [3], [2]]
    s = m.scores(x)
    best = max(itertools.product(range(3), repeat=4), key=lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(m.trans[a, b] for a, b in zip(y, y[1:])))
    assert [t for t, _ in m.decode(x)] == [m.tags[k] for k in best]


def test_crf_learns_from_all(spark):
    """Every sequence counts, however many there are; of weights so many that gradients are added up by ranges."""
    n = 26_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.array(F.array(F.col("id").cast("int"))).alias("features"), F.array(F.when(F.col("id") % 3 == 0, "BX").otherwise("O")).alias("tags"))
    m = crf.train(df, n, ["O", "BX"], 20)
    wrong = df.select("tags", crf.decode(df, F.col("features"), m).alias("p")).where("p[0].tag <> tags[0]")
    assert wrong.isEmpty()


def test_crf_gradient():
    """The packed gradient of sequences of several lengths is that of the likelihood by all taggings."""
    import itertools

    g = np.random.default_rng(1)
    seqs = [([[0, 2], [], [1]], [0, 1, 1]), ([[3]], [2]), ([[2], [9, 1], [0], [3, 3]], [1, 2, 0, 0])]
    obs, bias, trans = g.normal(size=(4, 3)), g.normal(size=3), g.normal(size=(3, 3))

    def likelihood(obs, bias, trans):
        total = 0.0
        for x, y in seqs:
            s = [bias + sum((obs[f] for f in fs if f < 4), np.zeros(3)) for fs in x]
            score = lambda z: sum(s[i][k] for i, k in enumerate(z)) + sum(trans[a, b] for a, b in zip(z, z[1:]))
            total += score(y) - np.log(sum(np.exp(score(z)) for z in itertools.product(range(3), repeat=len(x))))
        return total

    flat = [fs for x, _ in seqs for fs in x]
    p = crf.Pack(np.array([len(y) for _, y in seqs]), np.array([len(fs) for fs in flat]), np.array([f for fs in flat for f in fs]), np.array([k for _, y in seqs for k in y]), 4, 3)
    value, *grads = p.gradient(obs[p.ids], bias, trans)
    assert list(p.ids) == [0, 1, 2, 3] and value == pytest.approx(likelihood(obs, bias, trans))
    for w, grad in zip((obs, bias, trans), grads):
        for at in np.ndindex(w.shape):
            moved = [v.copy() for v in (obs, bias, trans)]
            k = next(i for i, v in enumerate((obs, bias, trans)) if v is w)
            moved[k][at] += 1e-6
            assert (likelihood(*moved) - likelihood(obs, bias, trans)) / 1e-6 == pytest.approx(grad[at], abs=1e-4)


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train_, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    p = L.train_profiles(train_)
    got = test.select(C.normalize_language(F.col("lang")).alias("a"), F.col("n_chars"), L.language(F.lit(None).cast("string"), L.detect(test, F.col("text"), F.lit(False), p)).alias("b")).where("n_chars > 100").collect()
    assert np.mean([r.a == r.b for r in got]) > 0.97
    c = L.compile_profiles(p)
    first = lambda t, **k: [f[0].language if f else None for f in L.classify([t], c, **k)][0]
    assert first("안녕하세요") == "kor" and first("123") is None and first(L.plain("<b>Γειά σου</b>", True)) == "ell" and first("これは漢字です") == "jpn" and first("汉字") == "zho"


def brute_trigrams(text, profiles):
    """Chunks of trigrams scored one by one."""
    words = "".join(x if x.isalpha() else " " for x in text.lower()).split()
    grams = [p[i : i + 3] for w in words for p in (f"_{w}_",) for i in range(len(p) - 2)]
    shares = {}
    for i in range(0, len(grams), L.CHUNK):
        part = grams[i : i + L.CHUNK]
        sums = {k: sum(v.get(g, min(v.values()) - 1) for g in part) for k, v in profiles.items()}
        best, second = sorted(sums, key=lambda k: -sums[k])[:2]
        held = shares.setdefault(best, [0, 0.0])
        held[0] += len(part)
        held[1] += len(part) * min(1.0, (sums[best] - sums[second]) / len(part) / L.SURE)
    return {k: (n / len(grams), r / n) for k, (n, r) in shares.items()}


def test_language_by_brute_force(spark, sf):
    p = L.train_profiles(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60] + ["a", "", "x 1 y", "Ab-cd!"]
    for text, found in zip(texts, L._totals(texts, L.compile_profiles(p), [[] for _ in texts])):
        want = brute_trigrams(text, p)
        assert {f.language for f in found} == set(want)
        assert all(f.share == pytest.approx(want[f.language][0]) and f.reliability == pytest.approx(want[f.language][1]) for f in found)


def test_language_judgement(monkeypatch):
    F_ = L.Found
    assert [f.language for f in L.judged([F_("eng", 0.8, 1.0), F_("pol", 0.2, 1.0)])] == ["pol", "eng"]
    assert [f.language for f in L.judged([F_("eng", 0.9, 1.0), F_("pol", 0.1, 1.0)])] == ["eng", "pol"]
    assert [f.language for f in L.judged([F_("deu", 0.75, 1.0), F_("fra", 0.25, 1.0)])] == ["deu", "fra"]
    assert [(f.language, f.share) for f in L.judged([F_("ces", 0.6, 1.0), F_("slk", 0.4, 0.5)])] == [("ces", 1.0)]
    assert [f.language for f in L.judged([F_("fra", 0.6, 0.1), F_("deu", 0.4, 0.9)])] == ["deu"] and [f.language for f in L.judged([F_("fra", 1.0, 0.1)])] == ["fra"]
    assert not L.reliable([F_("fra", 1.0, 0.1)]) and not L.reliable([]) and L.reliable([F_("fra", 0.5, 0.9)])
    assert L.squeezed("some different words in a text that is long enough to be looked at " * 10).count("words") == 1 and L.squeezed("short") is None
    assert L.squeezed(" ".join(f"word{i}" for i in range(200))) is None and L.squeezed("a    " * 100) == "a "
    c = L.compile_profiles(L.default_profiles())
    one = lambda t, h=None: L.classify([t], c, [h or []])[0][0].language
    assert one("Ceci est une phrase en français") == "fra" and one("Das ist ein deutscher Satz") == "deu" and one("Questa è una frase in italiano") == "ita"
    plain = L._totals(["la casa no"], c, [[]])[0][0]
    assert plain.language != "por" and L.HINT < 1
    monkeypatch.setattr(L, "HINT", 5.0)
    assert L._totals(["la casa no"], c, [["por"]])[0][0].language == "por"
    ids = L.language_ids()
    assert ids["und"] == 0 and len(set(ids.values())) == len(ids)


def test_language_hints(spark):
    df = spark.createDataFrame([('<html lang="fr-CA">', "https://a.b.de/x"), ('<meta http-equiv="Content-Language" content="es">', "http://x.com/"), ("<p>", None)], "h string, u string")
    got = df.select(L.html_hint(F.col("h")).alias("a"), L.domain_hint(F.col("u")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("fra", "deu"), ("spa", None), (None, None)]


def test_stopwords(spark):
    import unicodedata

    from textloom.functions import stopwords as S

    assert {"eng", "ita", "jpn", "por", "rus", "spa", "zho"} <= set(S.LISTS)
    lists = S.stopword_map({"eng": {"foo"}, "xxx": {"é"}})
    assert lists["eng"] == {"foo"} and unicodedata.normalize("NFD", "é") in lists["xxx"] and "é" in lists["xxx"] and "der" in lists["deu"]
    assert S.stopword_map({"a": {"b"}}, {"c": {"d"}}) == {"a": {"b"}, "c": {"d"}}
    assert S.stopword_frame(spark, {"a": {"b", "c"}}).count() == 2
    df = spark.createDataFrame([("eng", ["foo", "bar"]), ("unknown", ["foo", "der"]), (None, ["der"])], "l string, w array<string>")
    got = df.select(C.drop_stopwords(F.col("w"), S.stopword_column(lists, F.col("l"), "deu")).alias("w")).collect()
    assert [r.w for r in got] == [["bar"], ["foo"], []]


@given(st.text(alphabet="abZé19_-.,;:'’·!?()<>&=/%@#$\n\r\t ", max_size=25))
@settings(max_examples=300, deadline=None)
def test_simple_words(text):
    """The fast cut of common characters is that of the full rules, but for the apostrophes that these tailor before vowels."""
    fast, full = [], []
    T._words(text, 0, len(text), fast)
    T._complex_words(text, 0, full)
    if not re.search(r"['’](?=[aeiouyéè])", text, re.I):
        assert fast == full
    assert "".join(t for t, *_ in fast) == text


@given(st.lists(st.sampled_from(["a", " ", ":-)", "http://x.de/a?b", "&amp;", "&#65;", "<3", "o.O", "mailto:a@b.c", ":", "8-)", "x", "D:", "-_-", "(:", "tel:1"]), max_size=8))
@settings(max_examples=300, deadline=None)
def test_overlays(parts):
    text = "".join(parts)
    assert [m.span() for m in T._overlays(text, 0, len(text))] == [m.span() for m in T._OVERLAY.finditer(text)]


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"name": "n", "content": "c", "metadata": {"iso_639_1": "en"}, "annotations": [{"label": {"name": "l"}, "isPositive": true}]}\nnot json\n')
    rows = io.read_documents(spark, str(tmp_path / "d.json")).collect()
    assert rows[0].annotations[0].label == "l" and rows[0].annotations[0].is_positive and rows[1].content is None
    assert io.read_text_documents(spark, str(tmp_path / "d.json"), 3).count() == 2
    (tmp_path / "s.txt").write_text("the\nThe\n")
    assert io.read_stopwords(spark, f"file:{tmp_path}/s.txt", "eng").count() == 2
    with pytest.raises(ValueError):
        io.read_stopwords(spark, "http://x/y", "eng")
    body = b"2 3\n" + b"cat " + struct.pack("<3f", 1, 2, 3) + b"dog " + struct.pack("<3f", 4, 5, 6)
    (tmp_path / "v.bin.gz").write_bytes(gzip.compress(body))
    assert {r.word: list(r.vector) for r in io.read_word_vectors(spark, str(tmp_path / "v.bin.gz")).collect()} == {"cat": [1, 2, 3], "dog": [4, 5, 6]}
    assert len(io.parse_word_vectors(body[:-2])) == 1
    docs = spark.createDataFrame([(1, "a", "text, \"quoted\""), (2, "b", "x")], "doc_id long, name string, content string")
    pred = spark.createDataFrame([(1, "p", 0.5), (1, "q", 0.25)], "doc_id long, label string, probability double")
    wide = {r.Name: r for r in io.wide_predictions(docs, pred, ["q", "p"]).collect()}
    assert (wide["a"].p, wide["a"].q, wide["b"].p) == (0.5, 0.25, 0.0)
    io.write_csv(io.top_report(docs, R.argmax_label(pred)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().Label == "p"
    sp = spark.createDataFrame([(1, "p", 0.5, 0, 4)], "doc_id long, label string, probability double, offset int, length int")
    assert io.span_report(docs, sp).first().Span == "text"
    io.land_points(pred.withColumn("model_id", F.col("label")), str(tmp_path / "points"))
    io.land_points(pred.withColumn("model_id", F.col("label")), str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 4


def test_train_and_store(spark, tmp_path):
    rows = [(i, ("good nice fine " if i % 2 else "bad awful poor ") * 3 + f"w{i % 5}", float(i % 2)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y double")
    points = docs.select("doc_id", F.lit("pos").alias("label"), "y")
    m = train.KBinary(train.Featurizer(1, 2, 2)).fit(docs.select("doc_id", "text"), points)
    pred = m.predict(docs.select("doc_id", "text"))
    ev = {(r.metric_type, r.label): r.value for r in train.evaluate(pred, points).collect()}
    assert ev["F1", None] == 1 and ev["LabelF1", "pos"] == 1
    store.save(m.tables(), str(tmp_path / "m"), note="x")
    again = train.KBinary.from_tables(store.load(spark, str(tmp_path / "m")), least=1, most=2, minimum=2)
    assert R.close_enough(pred, again.predict(docs.select("doc_id", "text")), ["doc_id", "label"]).count() == 0
    assert store.manifest(spark, str(tmp_path / "m"))["properties"] == {"note": "x"} and store.training_summaries(spark, str(tmp_path / "m")) is None
    win = train.compete({"kbinary": lambda: train.KBinary(train.Featurizer(1, 1, 2))}, docs.select("doc_id", "text"), points).first()
    assert win.name == "kbinary" and win.f1 > 0.9


def test_graph_terminals(spark):
    """Vectors of several terminals side by side, as sums by hand; pruning and inverting dims; what can't be built."""
    docs = spark.createDataFrame([(1, "a b a", "en"), (2, "b c", "en"), (3, "", None)], "doc_id long, content string, l string")
    docs = docs.select("doc_id", "content", F.create_map(F.lit("iso_639_1"), F.col("l")).alias("metadata"))
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("c", [0.5, 0.0])], "feature string, embedding array<float>")
    ends = [("index", "IndexTransformer", {}), ("tfidf", "TfIdfTransformer", {"minimumDocumentObservations": 1}), ("w2v", "Word2VecTransformer", {"vectors": vectors})]
    config = GRAPH | {"transforms": [*GRAPH["transforms"], *[{"name": n, "class": f"some.package.{c}" if n == "x" else c, "config": k} for n, c, k in ends]]}
    config["pipeline"] = [*[p for p in GRAPH["pipeline"] if p["name"] != "$output"], *[{"name": n, "inputs": ["bag"]} for n, *_ in ends], {"name": "$output", "inputs": [n for n, *_ in ends]}]
    g = TransformGraph(config)
    with pytest.raises(ValueError):
        g.vectors(docs).count()
    g.prime(docs)
    assert g.dimension == 3 + 3 + 2
    got = {(r.doc_id, r.dim): r.value for r in g.vectors(docs).collect()}
    ln = np.log
    want = {(1, 0): 2, (1, 1): 1, (2, 1): 1, (2, 2): 1, (1, 3): 2 * (ln(2) - ln(1)), (2, 5): ln(2), (1, 6): 2.0, (1, 7): 4.0, (2, 6): 0.5, (2, 7): 0.0}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    dims = spark.createDataFrame([(i,) for i in range(8)], "dim int")
    assert {r.dim: r.feature for r in g.invert(dims).collect()} == {0: "a", 1: "b", 2: "c", 3: "a", 4: "b", 5: "c", 6: None, 7: None}
    g.prune(spark.createDataFrame([(0,), (5,)], "dim int"))
    assert {r.dim: r.feature for r in g.invert(dims).collect() if r.feature} == {0: "a", 5: "c"} and g.dimension == 8
    bad = config | {"pipeline": [*config["pipeline"], {"name": "grams", "inputs": ["index"]}]}
    with pytest.raises(ValueError):
        TransformGraph(bad)


def test_graph_detects_language(spark):
    config = {"version": "0.0.1", "transforms": [t for t in GRAPH["transforms"] if t["name"] in ("type", "lang")], "pipeline": [*[p for p in GRAPH["pipeline"] if p["name"] in ("type", "lang")], {"name": "$output", "inputs": ["lang"]}]}
    rows = [("This is an English document", "zh-Hant"), ("Ceci est une phrase en français", None), ("<!doctype html><div class='class names are often english text'>Ceci est une phrase en français</div>", None), ("12", None)]
    docs = spark.createDataFrame(rows, "content string, l string").select("content", F.create_map(F.lit("iso_639_1"), F.col("l")).alias("metadata"))
    assert [r.lang for r in TransformGraph(config).apply(docs).collect()] == ["zho", "fra", "fra", None]


def test_sources_more(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": [1,\n2]}')
    assert io.read_config(spark, str(tmp_path / "c.json")) == {"a": [1, 2]}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        io.read_config(spark, str(tmp_path / "l.json"))
    import decimal

    assert io.to_json_value({"a": [1, 2.5, None, True, decimal.Decimal("1.5")], "b": (np.int64(3), np.float32(0.5))}) == {"a": [1, 2.5, None, True, 1.5], "b": [3, 0.5]}
    for bad in ({1: 2}, object(), {"a": {2: 3}}):
        with pytest.raises(TypeError):
            io.to_json_value(bad)
    assert io.documents_from(spark, [{"name": "n", "content": "c"}, {"content": "d", "annotations": [{"label": {"name": "x"}, "isPositive": True}]}]).count() == 2
    with io.replay(spark.range(5), 3) as runs:
        assert [df.count() for df in runs] == [5, 5, 5]
    from pyspark.ml.feature import Word2Vec

    words = spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],)], "w array<string>")
    model = Word2Vec(vectorSize=3, minCount=1, inputCol="w", outputCol="v", seed=1).fit(words)
    model.save(str(tmp_path / "w2v"))
    want = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    got = {r.word: np.array(r.vector) for r in io.read_word2vec_model(spark, str(tmp_path / "w2v")).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], v, atol=1e-6) for k, v in want.items())
    vectors = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(9)], "word string, vector array<float>")
    io.write_word_vectors(vectors.repartition(3), str(tmp_path / "vectors"))
    assert sorted((r.word, list(r.vector)) for r in io.read_word_vectors(spark, str(tmp_path / "vectors")).collect()) == sorted((f"w{i}", [float(i), 1.0]) for i in range(9))


def test_more_metrics(spark):
    counts = spark.createDataFrame([(0, "a", 3), (1, "a", 4), (0, "b", 1)], "fold int, label string, n long")
    assert {r.label: r.n for r in metrics.average_counts(counts, ["label"]).collect()} == {"a": 3, "b": 1}
    values = spark.createDataFrame([("x", 2.0), ("x", 1.0), ("x", 1.0), ("y", 5.0)], "label string, value double")
    assert sorted(map(tuple, metrics.concatenate_values(values, ["label"]).collect())) == [("x", 0, 1.0), ("x", 1, 1.0), ("x", 2, 2.0), ("y", 0, 5.0)]
    m = spark.createDataFrame([("F1", "b", None, 0.0), ("F1", "a", "x", 0.0), ("AUROC", "z", None, 0.0)], "metric_type string, metric_class string, label string, x double")
    assert [r.metric_class for r in metrics.display_order(m).collect()] == ["z", "a", "b"]
    a = spark.createDataFrame([("m", "x", 0), ("m", "y", 1)], "model string, label string, class_id int")
    b = spark.createDataFrame([("m", "y", 5), ("n", "x", 2)], "model string, label string, class_id int")
    assert sorted(map(tuple, dataset.merge_class_ids(a, b).collect())) == [("m", "x", 0), ("m", "y", 5), ("n", "x", 2)]


def _labelled(spark, n=90):
    words = {0: "good nice fine", 1: "bad awful poor", 2: "red green blue"}
    rows = [(i, f"{words[i % 3]} w{i % 7} w{i % 5}", i % 3) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    points = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f"l{k}").alias("label"), (F.col("k") == k).cast("double").alias("y")) for k in range(3)])).alias("p")).select("doc_id", "p.*")
    return docs.select("doc_id", "text"), points


def test_forge_configurations(spark):
    """Trainers, furnaces and scales by configuration, and users' own."""
    docs, points = _labelled(spark)
    simple = {"jsonClass": "a.b.SimpleLogisticRegressionFurnaceBuilder", "maxIterations": 50, "regParam": [0.001], "elasticNetParam": [0.0]}
    per = {"jsonClass": "PerLabelFurnaceBuilder", "labelFurances": {"l0": simple, "l1": {"jsonClass": "HoldOutSetLogisticRegressionFurnace", "regParam": [0.01, 0.1]}, "l2": {"jsonClass": "XValLogisticRegressionFurnaceBuilder", "regParam": [0.01], "numFolds": 2}}}
    made = forge.from_config({"trainerConfig": {"jsonClass": "KClass1FPBuilder", "furnaceBuilder": per, "dataGenBuilder": {"scale": {"jsonClass": "BalancedBinaryScaleBuilder", "tolerance": 0.9}}, "pipeline": {"maxNgram": 1}}})
    pred = made().fit(docs, points).predict(docs)
    ev = {(r.metric_type, r.label): r.value for r in train.evaluate(pred, points).collect()}
    assert ev["F1", None] > 0.95
    with pytest.raises(KeyError):
        forge.from_config({"trainerConfig": {"jsonClass": "KClass1FP", "furnaceBuilder": {"jsonClass": "PerLabelFurnace", "labelFurnaces": {"l0": simple}}}})().fit(docs, points)
    with pytest.raises(KeyError):
        forge.from_config({"trainerConfig": {"jsonClass": "Unheard"}})
    multi = forge.from_config({"trainerConfig": {"jsonClass": "MultiClass1FPBuilder", "furnaceBuilder": {"jsonClass": "MultiClassLRFurnaceBuilder", "regParam": [0.01]}, "pipeline": {"maxNgram": 1}}})().fit(docs, points)
    best = {r.doc_id: r.label for r in R.argmax_label(multi.predict(docs)).collect()}
    assert all(best[i] == f"l{i % 3}" for i in range(90))
    assert multi.predict(spark.createDataFrame([(1, "unheard")], "doc_id long, text string")).agg(F.sum("probability")).first()[0] == pytest.approx(1)
    curve = forge.from_config({"trainerConfig": {"jsonClass": "LearningCurveTrainerBuilder", "portions": [0.5, 1.0], "numFolds": 2, "trainerBuilder": {"jsonClass": "KClass1FPBuilder", "furnaceBuilder": simple, "pipeline": {"maxNgram": 1}}}}).evaluate(docs, points)
    assert {len(r.points) for r in curve.collect()} == {2}

    @forge.register("trainer", "Classification", "MyOwn")
    def own(config):
        return lambda: train.Rates(F.substring("text", 1, config["letters"]))

    rivals = {"jsonClass": "CompetitiveTrainerBuilder", "numFolds": 2, "trainerBuilders": {"mine": {"jsonClass": "MyOwn", "letters": 3}, "worse": {"jsonClass": "MyOwn", "letters": 0}}}
    contest = forge.from_config({"trainerConfig": rivals})
    assert contest.evaluate(docs, points).first().name == "mine" and contest.fit(docs, points).predict(docs).count() == 270


def test_best_pipelines(spark):
    """A label that single words tell and one that only pairs of words tell each take their own pipeline."""
    rows = [(i, ("up " if i % 2 else "down ") + ("one two" if i % 4 < 2 else "two one"), i % 2, int(i % 4 < 2)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, b int")
    points = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in ("a", "b")])).alias("p")).select("doc_id", "p.*")
    makers = {"words": lambda: train.KBinary(train.Featurizer(1, 1, 1)), "pairs": lambda: train.KBinary(train.Featurizer(2, 2, 1))}
    m = train.BestPipelines(makers).fit(docs.select("doc_id", "text"), points)
    assert m.chosen == {"a": "words", "b": "pairs"}
    ev = {(r.metric_type, r.label): r.value for r in train.evaluate(m.predict(docs.select("doc_id", "text")), points).collect()}
    assert ev["F1", None] == 1.0


def test_chain_ner(spark):
    """Spans at the text's own offsets, learned from annotated texts; forged with rules; measured at three granularities."""
    import random

    r = random.Random(4)
    texts, gold = [], []
    for i in range(80):
        words = r.choices(["the", "a", "saw", "near", "with", ",", "ran"], k=r.randint(3, 8))
        at = r.randint(0, len(words))
        name = f"{r.choice(['Ann', 'Bob', 'Eve'])} {r.choice(['Smith', 'Jones', 'Brown'])}"
        words.insert(at, name)
        text = " ".join(words) + "."
        texts.append((i, text))
        gold.append((i, "person", text.index(name), len(name)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    ann = spark.createDataFrame(gold, "doc_id long, label string, offset int, length int")
    train_docs, test = docs.where("doc_id < 60"), docs.where("doc_id >= 60")
    model = ner.ChainNER(rounds=60).fit(train_docs, ann.where("doc_id < 60"))
    got = {(x.doc_id, x.label, x.offset, x.length) for x in model.predict(test).collect()}
    assert got == {g for g in gold if g[0] >= 60}
    again = ner.ChainNER(rounds=60).fit(train_docs, ann.where("doc_id < 60"))
    assert {(x.doc_id, x.offset) for x in again.predict(test).collect()} == {(d, o) for d, _, o, _ in got}
    wrong = ann.withColumn("length", F.when(F.col("doc_id") < 70, 3).otherwise(F.col("length"))).where("doc_id >= 60")
    ev = {(x.granularity, x.label): (x.tp, x.fp, x.fn) for x in ner.evaluate_spans(test, ann.where("doc_id >= 60"), wrong).collect()}
    assert ev["Span", "person"] == (10, 10, 10) and ev["Token", "person"] == (30, 0, 10) and ev["TokenTag", "Bperson"] == (20, 0, 0) and ev["TokenTag", "Iperson"] == (10, 0, 10)
    config = {"forgeName": "BasicSpanAlloyForge", "forgeConfig": {"rules": [["ran", "ran", 0.9]], "furnaces": [{"name": "r", "furnace": "SpanRuleFurnace"}, {"name": "c", "furnace": "ChainNERFurnace", "config": {"rounds": 60}}]}}
    made = forge.from_config(config)()
    assert made.names == ["rules.r", "model.c"]
    labels = {x.label for x in made.fit(train_docs, ann).predict(test).collect()}
    assert labels == {"person", "ran"}
    out = train.train_and_evaluate(lambda: ner.ChainNER(rounds=60), train_docs, test, ann, forge.evaluate_spans)
    assert {(x.summary, round(x.value, 3)) for x in out.where("metric_type = 'F1'").collect()} == {("TEST", 1.0), ("TRAIN", 1.0)}


def test_classification_forge(spark):
    docs, _ = _labelled(spark, 9)
    made = forge.from_config({"forgeName": "BasicClassificationForge", "forgeConfig": {"furnaces": [{"name": "a", "furnace": "RuleFurnace", "config": {"rules": [{"label": "x", "expression": "good", "weight": 0.8}]}}]}})
    got = made().fit(docs, None).predict(docs).collect()
    assert {r.doc_id for r in got} == {0, 3, 6} and {round(r.probability, 3) for r in got} == {0.8}


def test_graph(spark):
    g = TransformGraph(GRAPH)
    assert g.stages[0] == ["content", "type"] and g.stages[-1] == ["grams"]
    docs = spark.createDataFrame([("A b!", {"iso_639_1": "en"})], "content string, metadata map<string, string>")
    assert g.apply(docs).first().grams == ["a b", "b !", "a", "b", "!"]

    def broken(**change):
        return GRAPH | change

    p = GRAPH["pipeline"]
    for bad in (broken(version="9"), broken(pipeline=p[:-1]), broken(pipeline=[*p[:-1], {"name": "$output", "inputs": ["nope"]}]), broken(pipeline=[{"name": "bag", "inputs": ["content"]}, *[x for x in p if x["name"] != "bag"]]), broken(transforms=[{"name": "$x", "class": "Lift"}]), broken(transforms=[{"name": "x", "class": "Nope"}])):
        with pytest.raises(ValueError):
            TransformGraph(bad)


def test_streaming(spark, tmp_path):
    """A stream of files scores as the batch does."""
    batch = spark.createDataFrame([(1, "good good"), (2, "bad")], "doc_id long, text string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    rule_list = [("x", "good", 0.8)]
    q = score.score_rules(stream, rule_list).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").collect() == score.score_rules(batch, rule_list).collect()
    words = batch.select("doc_id", F.split("text", " ").alias("w"))
    assert score.score_linear(words, "w", {"good": 1.0}, -1.0).orderBy("doc_id").first().probability == pytest.approx(1 / (1 + np.exp(-1)))


def test_multiclass(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(90, 3)) + 4 * np.eye(3)[np.arange(90) % 3]
    df = models.dense_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), "v", "i").withColumn("y", (F.col("doc_id") % 3).cast("double"))
    w, b = models.train_multiclass(df, 3)
    m = np.stack([np.zeros(90), *[x @ w[k] + b[k] for k in (1, 2)]], 1)
    assert (m.argmax(1) == np.arange(90) % 3).mean() > 0.9
