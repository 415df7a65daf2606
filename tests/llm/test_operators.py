"""Each operator against brute force on small tables with nulls, empties, long texts, ties, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import common, decontaminate, licenses, mixing, pii, quality, recompress, rules, secrets, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = ["w%d" % i for i in range(4000)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, texts, ids=None, source="s0"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)


EDGE = [None, "", "   ", "\n\n", "a", "!!!", "x" * 200_000, "é\U0001f600ß İ", "a b " * 30_000, "a", "a"]
EDGE_IDS = [1, 2, 3, 4, None, 6, 7, 8, 9, 10, 10]


@pytest.fixture(scope="module")
def edge(spark):
    extra = ["score", "spans", "found", "fp", "rank", "root", "Text_", "position", "bucket", "doc"]
    from pyspark.sql import functions as F

    df = frame(spark, EDGE, EDGE_IDS)
    return df.withColumns({c: F.lit("own") for c in extra})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(30)), (2, None), (3, ""), (4, "one two"), (None, prose(12))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 0, None), (10, None, 0), (None, 1, 1), (7, 1, 0), (7, 1, 0), (8, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


def test_edges(spark, edge, bench, labels):
    """No operator fails on odd rows, and those that keep documents keep all their columns."""
    model = quality.fit(edge, labels)
    n = edge.count()
    assert quality.score_documents(edge, model).count() == n
    assert quality.keep_good(edge, model, threshold=-1e9).columns == edge.columns
    assert simhash.near_duplicates(edge).where("doc_id = 1").count() == 0
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(t == "a" for _, t in left) == 1 and sum(not (t or "").strip("! \n") for _, t in left) == 5
    assert decontaminate.decontaminate(edge, bench).columns == edge.columns
    assert decontaminate.decontaminate(edge, bench).count() == n
    assert secrets.redact_secrets(edge).columns == edge.columns
    assert secrets.redact_secrets(edge).count() == n
    assert secrets.find_secrets(edge).count() == pii.find_pii(edge).count() == licenses.scan_licenses(edge).count() == 0
    assert recompress.repeated_spans(edge).count() == 0
    assert rules.measured(edge).count() == n and rules.filter_documents(edge).columns == edge.columns
    hist = token_counts.length_histogram(edge).collect()
    assert sum(r.n_docs for r in hist) == n
    assert mixing.mix(edge, carry=("text",)).where("text is null").count() == 0


def test_empty(spark, bench, labels):
    none = spark.createDataFrame([], SCHEMA)
    model = quality.fit(none, labels)
    assert quality.keep_good(none, model).count() == simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0
    assert decontaminate.leaks(none, bench).count() == secrets.find_secrets(none).count() == pii.find_pii(none).count() == 0
    assert licenses.scan_licenses(none).count() == recompress.repeated_spans(none).count() == rules.measured(none).count() == 0
    assert token_counts.length_histogram(none).count() == mixing.mix(none).count() == 0
    docs = frame(spark, ["some words here"])
    empty_bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty_bench).collect() == docs.collect()
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")).score(["x"])[0] == 0


@given(st.lists(st.text(alphabet="aB é1_-\n\U0001f600ß𐐀", max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_scan(texts):
    h, doc, start, size = common.scan(texts) if texts else ([], [], [], [])
    found = [(d, texts[d][s : s + n]) for d, s, n in zip(doc, start, size)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"\w+", t)]
    by = {}
    for (_, w), x in zip(found, h):
        assert by.setdefault(int(x), w.lower()) == w.lower() or len(w) != len(w.lower())


def test_token_counts(spark):
    texts = ["hello world", "", None, "Hello, it's 42!\n\n  x", "hello world"] + [prose(n) for n in (1, 5, 5, 90)]
    with open(token_counts.VOCABULARY, "rb") as f:
        enc = token_counts._encoder(f.read())
    lengths = [len(enc.encode_ordinary(t or "")) for t in texts]
    df = token_counts.length_histogram(frame(spark, texts))
    for r in df.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths) and r.tokens_at_most == sum(x for x in lengths if x <= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
    rows = token_counts.at_limits(df, [0, 3, 4, 17, 10**6]).collect()
    assert len(rows) == 5
    for r in rows:
        kept = sum(min(x, r.context_limit) for x in lengths)
        assert (r.docs_that_fit, r.kept_tokens, r.lost_tokens) == (sum(x <= r.context_limit for x in lengths), kept, sum(lengths) - kept)
    qs = [0.1, 1 / 3, 0.5, 0.9, 1.0]
    want = {q: min(n for n in lengths if sum(x <= n for x in lengths) / len(lengths) >= q) for q in qs}
    assert {r.q: r.n_tokens for r in token_counts.quantiles(df, qs).collect()} == want
    none = token_counts.length_histogram(frame(spark, []))
    assert [tuple(r) for r in token_counts.at_limits(none, [5]).collect()] == [(5, 0, 0, 0)] and token_counts.quantiles(none, [0.5]).count() == 0


def test_token_parts(monkeypatch):
    """Long texts are encoded in parts without another result."""
    with open(token_counts.VOCABULARY, "rb") as f:
        enc = token_counts._encoder(f.read())
    text = " ".join(["word12 it's, ok\n\n  then"] * 200)
    monkeypatch.setattr(token_counts, "PART_CHARS", 100)
    assert token_counts.count_tokens(text, enc) == len(enc.encode_ordinary(text))


def test_secrets():
    key = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"
    cases = {
        f'token = "{key}"': [key], f"password: {key}": [key], f'{{"api_key": "{key}", "color": "red"}}': [key], f"export AWS_SECRET_KEY='{key}'": [key],
        f'x = "{key}"\npassword = x': [key], f'a = "{key[:20]}"\nb = "{key[20:]}"\nsecret = a + b': [key[:20], key[20:]], f'base="{key}"\nauth_token="${{base}}"': [key],
        f'const apiKey = "{key}";': [key], 'password = "changeme"': [], 'password = os.environ["X"]': [], f'title = "{key}"': [], f'public_key = "{key}"': [], "we said: token or not": [],
        'token = ""': [], "a == b": [], "": [], f"secret_key := `{key}`": [key], f"'token' => '{key}'": [key],
    }
    for text, want in cases.items():
        assert [text[a:b] for a, b, *_ in secrets.secrets_of(text)] == want, text
    assert secrets.secrets_of("x = x + 'abcdefgh1'\n" * 500) == []


def test_secrets_whole():
    """Values after long blanks, on the next line, in brackets, of very many parts, and unclosed."""
    key = "x9!Kd82jsPq"
    for text in (f'db_password{" " * 12}= "{key}"', f"db_password{' ' * 9}: {key}", f'db_password ={" " * 30}"{key}"', f'db_password =\n    "{key}"', f'password = (\n    "{key}"\n)', f'tokens_secret = ["{key}"]'):
        assert [text[a:b] for a, b, *_ in secrets.secrets_of(text)] == [key], text
    many = [f"{i:04d}aZ" for i in range(100)]
    text = "password = " + " + ".join(f'"{x}"' for x in many)
    assert [text[a:b] for a, b, *_ in secrets.secrets_of(text)] == many
    text = "a = " + " + ".join(f'"{x}"' for x in many) + "\npassword = a"
    assert [text[a:b] for a, b, *_ in secrets.secrets_of(text)] == many
    text = 'password = "' + "x9!Kd82jsPq" * 500
    assert [(a, b) for a, b, *_ in secrets.secrets_of(text)] == [(12, len(text))]
    assert secrets.secrets_of('password:\n  "color": "f0ddae3b09ae356cbefecdd3"') == []
    assert len(secrets.secrets_of("password = password + 'abcdefgh1'\n" * 20_000)) == 20_000
    assert secrets.secrets_of(("a" + " " * 50) * 5_000 + "=") == []


def test_secrets_below():
    """Element text, and values on the lines below their key."""
    key = "x9!Kd82jsPq"
    for text in (f"<password>{key}</password>", f"<db><Secret kind='a'>\n {key}\n</Secret></db>", f"<token><![CDATA[{key}]]></token>", f"a: 1\npassword:\n  {key}\nb: 2", f"  db_password: |\n    {key}\n  user: x", f"secrets:\n  - name: a\n    password:\n      {key}", f"tokens_secret:\n  - {key}\n"):
        assert [text[a:b] for a, b, *_ in secrets.secrets_of(text)] == [key], text
    for text in (f"password:\n{key}", f"password:\n  color: {key}", f"<title>{key}</title>", "<password></password>", "password:\n\n"):
        assert secrets.secrets_of(text) == [], text
    text = f"private_key: |\n  -----BEGIN-----\n  {key}{key}\n  Zz{key}\nname: x"
    assert [text[a:b] for a, b, *_ in secrets.secrets_of(text)] == ["-----BEGIN-----", key + key, "Zz" + key]


def random_program(r):
    """Lines of assignments in many syntaxes, and the literals that reach a sensitive name."""
    lines, want, known = [], [], {}
    literal = lambda n=18: "".join(r.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(n - 2)) + "7q"
    gap = lambda: " " * r.choice([0, 1, 1, 2, 7, 20])
    for k in range(r.randint(1, 14)):
        sensitive = r.random() < 0.5
        name = r.choice(["db_password", "API_KEY", "auth.token", "clientSecret", "aws-secret-key", "passphrase"] if sensitive else ["title", "color_name", "public_key", "user", "maxTokens"])
        word = name.replace(".", "_").replace("-", "_")
        q = r.choice("\"'")
        kind = r.randrange(9)
        a, b = literal(), literal()
        if kind == 0:
            lines.append(f"{word}{gap()}={gap()}{q}{a}{q}")
            own = [a]
        elif kind == 1:
            lines.append(f"{name}:{gap() or ' '}{a}")
            own = [a]
        elif kind == 2:
            lines.append(f'{{"{word}":{gap()}"{a}", "size": 3}}')
            own = [a]
        elif kind == 3:
            lines.append(f"const {word} = {q}{a}{q}{gap()}+{gap()}{q}{b}{q};")
            own = [a, b]
        elif kind == 4:
            lines += [f"v{k} = {q}{a}{q}", f"{word} = v{k}"]
            own = [a]
        elif kind == 5:
            lines += [f"part{k}={q}{a}{q}", f'{word}="${{part{k}}}"']
            own = [a]
        elif kind == 6:
            lines += [f"x{k} = {q}{a}{q}", f"y{k} = x{k} + {q}{b}{q}", f"{word} = y{k}"]
            own = [a, b]
        elif kind == 7:
            lines.append(f"<{word}>{a}</{word}>")
            own = [a]
        else:
            lines.append(f"{word} = {q}{r.choice(['changeme', 'example', '', 'xxxx', 'none'])}{q}")
            own = []
        if sensitive:
            want += own
        if r.random() < 0.5:
            lines.append(r.choice(["", "some words of text", "# note", "}"]))
    return "\n".join(lines), sorted(want)


def test_secrets_of_programs(spark):
    """Every literal that reaches a sensitive name, and no other, in programs made up with what is in them known."""
    r = random.Random(21)
    made = [random_program(r) for _ in range(400)]
    for text, want in made:
        assert sorted(text[a:b] for a, b, *_ in secrets.secrets_of(text)) == want, text
    docs = frame(spark, [t for t, _ in made[:60]])
    got = collections.defaultdict(list)
    for x in secrets.find_secrets(docs).collect():
        got[x.doc_id].append(made[x.doc_id][0][x.start : x.end])
    assert all(sorted(got[i]) == want for i, (_, want) in enumerate(made[:60]))


def test_redact(spark):
    docs = frame(spark, ['one token = "f0ddae3b09ae356cbefecdd3" two secret: "9f0ddae3b09ae356cbefecdd4"', "plain", None])
    out = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert out[0].text == 'one token = "[SECRET]" two secret: "[SECRET]"' and out[0].n_chars == len(out[0].text)
    assert out[1].text == "plain" and out[2].text is None


def test_licenses(spark):
    r = random.Random(3)
    names = list(licenses.TEMPLATES)
    texts = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(1, 4)):
            words = licenses.template_words(licenses.TEMPLATES[r.choice(names)])
            keep = [w for w in words if r.random() < 0.85] + r.choices(VOCAB, k=r.randint(0, 6))
            r.shuffle(keep)
            lines.append(" ".join(keep).upper() if r.random() < 0.3 else " ".join(keep))
        texts.append("\n".join(lines))
    want = set()
    for i, t in enumerate(texts):
        for b, line in enumerate(t.lower().split("\n")):
            words = set(re.findall(r"[^\W_]+", line))
            for n, tpl in licenses.TEMPLATES.items():
                s = set(licenses.template_words(tpl))
                if len(s & words) >= licenses.need(len(s), licenses.THRESHOLD):
                    want.add((i, b, n, len(s & words)))
    got = {(x.doc_id, x.block, x.template, x.overlap) for x in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert got == want and want


def test_licenses_wrapped(spark):
    """Notices over several lines, and the notices and standard texts that had no template."""
    texts = [
        "Some words.\n# Licensed under the Apache License,\n# Version 2.0.\nMore.",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
        "x\n\nThis Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0. If a copy",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without\nrestriction",
        "a\nLicensed under CC BY-NC 4.0.",
        "This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation",
        "Released under the MIT License.\nReleased under the\nMIT License.",
        "released\n" + "filler words here\n" * 9 + "under the mit license"[:9] + "\n" + "other filler\n" * 9 + "mit",
    ]
    got = {(x.doc_id, x.block, x.template) for x in licenses.scan_licenses(frame(spark, texts), runs=True).collect()}
    assert {(0, 1, "apache-2.0"), (1, 0, "bsd-text"), (2, 2, "mpl-2.0-header"), (3, 0, "mit-text"), (4, 1, "cc-by-nc-4.0"), (5, 0, "gpl-header"), (6, 0, "mit"), (6, 1, "mit")} <= got
    assert not any(d == 7 for d, *_ in got) and not {(0, 1, "mit"), (6, 0, "apache-2.0")} & got


def brute_runs(lines, words, o, spread):
    """Each end from left to right, and from it back word by word to the shortest stretch that holds enough."""
    tokens = [(w, i) for i, line in enumerate(lines) for w in line]
    alone = {i for i, line in enumerate(lines) if len(words & set(line)) >= o}
    out, low = [], 0
    for e, (w, i) in enumerate(tokens):
        if w in words and i in alone:
            low = e + 1
        if w not in words or i in alone:
            continue
        for b in range(e, max(low, e - spread * len(words) + 1) - 1, -1):
            if len(words & {x for x, _ in tokens[b : e + 1]}) >= o:
                first = tokens[b][1]
                out.append((first, len(words & {x for line in lines[first : i + 1] for x in line})))
                low = e + 1
                break
    return out


@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=6), max_size=8))
@settings(max_examples=200, deadline=None)
def test_runs_of_lines(lines):
    words, o = set("abcde"), 4
    known = [[w if w in words else None for w in line] for line in lines]
    got = licenses.wrapped(known, [(words, o)], {w: [0] for w in words})
    assert [(a, n) for a, _, n in got] == brute_runs(lines, words, o, licenses.SPREAD)


def near_copies(n, r, size=120):
    texts = []
    for _ in range(n):
        base = [r.choice(VOCAB) for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            texts.append(" ".join(r.choice(VOCAB) if r.random() < 0.04 else w for w in base))
    return texts


def brute_groups(fps, distance):
    """All near pairs and each point's smallest connected point, pair by pair."""
    words = [int(a) << 64 | int(b) for a, b in fps.tolist()]
    pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if (words[i] ^ words[j]).bit_count() <= distance]
    root = list(range(len(words)))
    for _ in words:
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return pairs, root


def brute_fingerprint(text):
    hashes = {int(x) >> 20 for x in common.scan([text])[0]}
    half = len(hashes) / 2
    mixed = [[int(common.mix64(np.array([np.uint64(h) + k], np.uint64))[0]) for k in (np.uint64(1), np.uint64(0x9E3779B97F4A7C15))] for h in hashes]
    votes = [sum(m[w] >> b & 1 for m in mixed) > half for w in (0, 1) for b in range(64)]
    return [sum(1 << b for b in range(64) if votes[64 * w + b]) for w in (0, 1)]


@pytest.mark.parametrize("cap", [4096, 40])
def test_simhash_recall(spark, cap):
    """Against all pairs within the distance, also where buckets are split further."""
    texts = near_copies(300, random.Random(cap))
    texts += ["same words again"] * 30
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(frame(spark, texts), bucket_cap=cap).collect()}
    fp, has = simhash.fingerprints(texts)
    pairs, root = brute_groups(fp, simhash.MAX_DISTANCE)
    found = sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs)
    assert has.all() and found >= 0.9 * len(pairs)
    assert all(root[a] == root[g] for a, g in got.items())
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, texts), bucket_cap=cap).select("doc_id").collect()}
    assert kept == set(range(len(texts))) - set(got) | set(got.values())


def test_simhash_repeated_rows(spark):
    """Rows that agree in id and text are one of a group; null ids go first, equal ids by text."""
    docs = frame(spark, ["one two three"] * 3 + ["one two three", "four five six", "four five six", None, None], [7, 7, None, 3, None, None, 1, 1])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.drop_near_duplicates(docs).collect()) == [(False, 1, ""), (False, 1, ""), (False, 3, "one two three"), (True, 0, "four five six")]


def test_fingerprint_bits():
    texts = [prose(n) for n in (1, 2, 9, 40)] + ["a a a b", "Aa aA"]
    fp, has = simhash.fingerprints(texts)
    assert has.all() and [[int(x) for x in row] for row in fp] == [brute_fingerprint(t) for t in texts]


def test_simhash_tables(spark):
    """At every number of bits enough tables for the recall at the limit, and splits that miss next to nothing."""
    from math import comb

    for bits in range(4, 41):
        tables = simhash.tables_for(bits)
        assert 1 - (1 - comb(128 - simhash.MAX_DISTANCE, bits) / comb(128, bits)) ** tables >= 0.919
    g = np.random.default_rng(4)
    a = g.integers(0, 2, (600, 128), np.uint8)
    b = a.copy()
    for row in b:
        row[g.choice(128, 24, replace=False)] ^= 1
    words = [np.packbits(x, axis=1).view(np.int64).tolist() for x in (a, b)]
    points = spark.createDataFrame([tuple(x) for x in words[0] + words[1]], "hi long, lo long")
    found = {frozenset(((r.a_hi, r.a_lo), (r.b_hi, r.b_lo))) for r in simhash.edges(points, tables=12, bits=1, bucket_cap=100).collect()}
    assert sum(frozenset((tuple(x), tuple(y))) in found for x, y in zip(*words)) >= 0.995 * len(a)


def family(size, flips, r):
    """Points around one centre, each of its bits turned over with the given chance."""
    centre = r.integers(0, 2, 128, np.uint8)
    bits = centre ^ (r.random((size, 128)) < flips).astype(np.uint8)
    return np.unique(np.packbits(bits, axis=1).view(np.uint64), axis=0)


@pytest.mark.parametrize("flips", [0.03, 0.06])
def test_dense_bucket(flips):
    """Fifty thousand near-identical fingerprints in one bucket: one family, in bounded memory, though over a thousand million pairs are near."""
    import tracemalloc

    r = np.random.default_rng(3)
    some = family(50_000, flips, r)
    far = r.integers(0, 2**63, (3_000, 2)).astype(np.uint64)
    points = np.concatenate([some, far])
    tracemalloc.start()
    root, left = simhash._bucket(points, 24, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and not len(left)
    sizes = np.bincount(root[: len(some)])
    assert sizes.max() >= 0.999 * len(some) and (root[len(some) :] == np.arange(len(some), len(points))).all()


def test_bucket_is_exact():
    """Contraction loses no link: the same components as pair by pair, families, chains and loose points together."""
    for seed in range(6):
        r = np.random.default_rng(seed)
        chain = [r.integers(0, 2, 128, np.uint8)]
        for _ in range(40):
            step = chain[-1].copy()
            step[r.choice(128, 20, replace=False)] ^= 1
            chain.append(step)
        points = np.unique(np.concatenate([family(250, 0.05, r), family(120, 0.12, r), np.packbits(np.array(chain), axis=1).view(np.uint64)]), axis=0)
        root, left = simhash._bucket(points, 24, 60)
        root = simhash._connect(points, 24, root, left)
        assert root.tolist() == brute_groups(points, 24)[1]


def test_corpus_wide_family(spark, monkeypatch):
    """A family of a third of all points is linked by map-only passes, with what hangs on to it."""
    r = np.random.default_rng(9)
    some, loose = family(900, 0.03, r), r.integers(0, 2**63, (1500, 2)).astype(np.uint64)
    rim = some[:40].copy()
    for row in rim:  # near one member, mostly too far from the centre's
        for b in r.choice(64, 18, replace=False).tolist():
            row[0] ^= np.uint64(1) << np.uint64(b)
    points = np.unique(np.concatenate([some, loose, rim]), axis=0)
    df = spark.createDataFrame([tuple(x) for x in points.view(np.int64).tolist()], "hi long, lo long")
    found, left = simhash.families(df, len(points), 24, 100)
    assert left.count() <= len(points) - 0.8 * len(some)
    index = {tuple(x): i for i, x in enumerate(points.view(np.int64).tolist())}
    pairs = [(index[r.a_hi, r.a_lo], index[r.b_hi, r.b_lo]) for r in simhash.edges(df, bucket_cap=100).collect()]
    root = simhash._join(np.arange(len(points)), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = brute_groups(points, 24)[1]
    assert np.mean(root == want) >= 0.99 and all(want[a] == want[b] for a, b in pairs)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_mixing(spark):
    rows = [(i, prose(rng.randint(1, 30)), "en", f"src{i % 5}" if i % 7 else None, 0) for i in range(400)] + [(1000, "", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, max_epochs=2).collect()
    positions = [r.position for r in out]
    assert positions == sorted(positions) and 0 <= min(positions) and max(positions) <= 1
    total = sum(len(t.split()) for _, t, *_ in rows)
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        supply = sum(len(t.split()) for _, t, _, x, _ in rows if x == s)
        seg = mixing.segments(spark.createDataFrame([(x,) for x in ("src0", "src1", "src2", "src3", "src4", None)], "source string")).collect()
        demand = max(x.d1 for x in seg if x.source == s) * total
        used = sum(r.n_tokens for r in mine)
        assert used >= min(demand, 2 * supply) - 1e-6 and used <= min(demand + 30, 2 * supply)
    assert sum(x.s0 for x in seg if x.t0 == 0.5) == pytest.approx(1)


def brute_mix(rows, schedules, seed=mixing.SEED, steps=200_000):
    """Positions by stepping through training time in small steps and reading each source's next document when its demand is there."""
    import hashlib

    docs = collections.defaultdict(list)
    for i, text, _, source, _ in rows:
        if n := len((text or "").split()):
            docs[source].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, n))
    total = sum(n for d in docs.values() for *_, n in d)
    weight = lambda s, t: mixing._weight(schedules[s], t) if s in schedules else mixing.DEFAULT
    knots = sorted({0.0, 1.0, *(t for s in schedules.values() for t, _ in s)})
    share = {s: [weight(s, t) / sum(weight(x, t) for x in docs) for t in knots] for s in docs}
    out = []
    for s, mine in docs.items():
        mine.sort()
        at, k, demand = 0, 0, 0.0
        for step in range(steps):
            t = (step + 0.5) / steps
            while demand >= at - 1e-6:
                out.append((mine[k % len(mine)][1], k // len(mine), step / steps))
                at += mine[k % len(mine)][2]
                k += 1
            demand += np.interp(t, knots, share[s]) * total / steps
    return out


def test_mixing_positions(spark):
    """Each document's positions against training stepped through, in brute force."""
    r = random.Random(2)
    rows = [(i, prose(r.randint(1, 30), r), "en", r.choice(["src0", "src0", "src0", "src1", "src3", None]), 0) for i in range(150)] + [(900, "x y z", "en", "tiny", 0)]
    got = {(x.doc_id, x.epoch): x.position for x in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(i, e): t for i, e, t in brute_mix(rows, mixing.SCHEDULES)}
    late = {k for k, t in want.items() if t > 0.999} | {k for k, t in got.items() if t > 0.999}
    assert set(got) - late == set(want) - late and max(abs(got[k] - want[k]) for k in set(want) - late) < 2e-3


def test_mixing_clash(spark):
    """Carried columns that are named like the result's stay, under another name."""
    docs = frame(spark, ["a b", "c d e"]).selectExpr("*", "'mine' AS Position", "1 AS epoch", "2 AS n_tokens", "3 AS c0", "4 AS mix")
    out = mixing.mix(docs, carry=("text", "Position", "epoch", "n_tokens", "c0", "mix"))
    assert out.columns == ["doc_id", "source", "epoch", "n_tokens", "position", "text", "_Position", "_epoch", "_n_tokens", "c0", "mix"]
    assert [(r.doc_id, r._Position, r._epoch, r._n_tokens, r.c0, r.mix) for r in out.collect()][0][1:] == ("mine", 1, 2, 3, 4)


def test_mixing_small_source(spark):
    """A source of little supply starts over until its demand is met, to the end of training."""
    rows = [(0, "a b c", "en", "src0", 0)] + [(i, "w " * 50, "en", "big", 0) for i in range(1, 200)]
    out = [r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect() if r.source == "src0"]
    assert sum(r.n_tokens for r in out) > 0.5 * 9953 and max(r.position for r in out) > 0.99
    assert [r.epoch for r in out] == list(range(len(out)))


def test_quality_brute_force(spark):
    """Indicators, ratios and scores word by word; the weights are those of the primal problem, solved by small steps."""
    r = random.Random(5)
    texts = [prose(r.randint(1, 12), r) + r.choice(["", " !!", " w1 w1", " a b a"]) for _ in range(40)] + ["", "x"]
    y = [1.0 if i % 3 else -1.0 for i in range(len(texts))]
    size = 1 << quality.BITS

    def grams(t):
        h = [int(x) for x in common.scan([t], symbols=True)[0]]
        mask, full = size - 1, (1 << 64) - 1
        mix = lambda x: int(common.mix64(np.array([x & full], np.uint64))[0])
        out = {x & mask for x in h} | {mix(a * 3 + b) & mask for a, b in zip(h, h[1:])}
        return out | ({1} if any(a == b for a, b in zip(h, h[1:])) else set()) | ({2} if any(a == b for a, b in zip(h, h[2:])) else set())

    sets = [grams(t) for t in texts]
    doc, feat = quality.indicators(texts)
    assert [sorted(feat[doc == i].tolist()) for i in range(len(texts))] == [sorted(s) for s in sets]
    up, down = (collections.Counter(f for s, v in zip(sets, y) if v == sign for f in s) for sign in (1.0, -1.0))
    total = [size + sum(c.values()) for c in (up, down)]
    ratio = lambda f: np.log((1 + up[f]) / total[0]) - np.log((1 + down[f]) / total[1])
    rr, w, b = quality.fit_rows(doc, feat, np.array(y), size, passes=4000, tolerance=1e-8)
    assert all(rr[f] == pytest.approx(ratio(f), abs=1e-9) for s in sets for f in s)
    used = sorted(set().union(*sets))
    x = np.zeros((len(texts), len(used) + 1))
    for i, s in enumerate(sets):
        norm = np.sqrt(sum(ratio(f) ** 2 for f in s)) or 1.0
        for f in s:
            x[i, used.index(f)] = ratio(f) / norm
    x[:, -1] = 1.0
    f = lambda v: v @ v / 2 + np.maximum(0, 1 - np.array(y) * (x @ v)).sum()
    v, best = np.zeros(x.shape[1]), np.inf
    for step in range(60_000):
        on = np.array(y) * (x @ v) < 1
        v -= (v - (np.array(y)[on, None] * x[on]).sum(0)) / (step + 10)
        best = min(best, f(v))
    mine = np.append(w[used], b)
    assert f(mine) <= best + 1e-3 and not np.delete(w, used).any()
    assert quality.QualityModel(rr, w, b).score(texts) == pytest.approx(x @ mine)


def test_quality_labels(spark):
    """Toxic rows are no good ones; ties and nulls don't train."""
    good, bad = ["fine %d words" % i for i in range(30)], ["awful %d words" % i for i in range(30)]
    docs = frame(spark, good + bad)
    rows = [(i, 1, None if i % 2 else 0) for i in range(30)] + [(i, 1, 1) for i in range(30, 60)] + [(60, None, 0), (0, 1, 0)]
    model = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    assert (model.score(good) > 0).all() and (model.score(bad) < 0).all()


def test_quality_held_out(spark):
    r = random.Random(8)
    good = [prose(r.randint(5, 60), r) + "." for _ in range(300)]
    bad = [" ".join(w + r.choice(["%%%", "###", "!!"]) for w in prose(r.randint(5, 60), r).split()) for _ in range(100)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad]
    r.shuffle(rows)
    docs = frame(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if i < 200], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    score = model.score([t for t, _ in rows])
    assert np.mean([(s >= 0) == (y == 1) for s, (_, y) in list(zip(score, rows))[200:]]) > 0.97
    assert [x.score for x in quality.score_documents(docs, model).orderBy("doc_id").collect()] == pytest.approx(score.tolist())


def test_dual_coordinate_descent():
    """The hinge loss's optimum: no single step along an axis lowers the objective."""
    g = np.random.default_rng(2)
    x = g.normal(size=(60, 5))
    y = np.sign(x[:, 0] + 0.3 * g.normal(size=60))
    w, b = quality.dual_coordinate_descent(list(x), [np.arange(5)] * 60, y, 5, c=1.0, passes=5000, tolerance=1e-9)
    f = lambda v, c: (v @ v + c * c) / 2 + np.maximum(0, 1 - y * (x @ v + c)).sum()
    for k in range(5):
        for e in (1e-3, -1e-3):
            v = w.copy()
            v[k] += e
            assert f(v, b) >= f(w, b) - 1e-4


@given(st.lists(st.integers(1, 4), min_size=0, max_size=60))
@settings(max_examples=80, deadline=None)
def test_fm_index(seq):
    index = decontaminate.FMIndex(np.array(seq, np.int64), 5, every=4)
    for n in (1, 2, 3):
        phrases = np.array([[a, b, c][:n] for a in range(1, 5) for b in range(1, 5) for c in range(1, 5)])
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), lo, hi):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(seq) - n + 1) if seq[i : i + n] == p]


def brute_leaks(texts, items, n=8, least=5):
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = common.words_of(t or "")
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k >= least else 0):
            phrases[tuple(w[j : j + k])].add(i)
    out = []
    for d, t in enumerate(texts):
        w = [(m.start(), m.end(), m.group().lower()) for m in common.WORD.finditer(t or "")]
        spans = []
        for j in range(len(w)):
            for k in {len(p) for p in phrases}:
                if (p := tuple(x[2] for x in w[j : j + k])) in phrases:
                    if spans and j <= spans[-1][1]:
                        spans[-1] = [spans[-1][0], max(spans[-1][1], j + k), spans[-1][2] | phrases[p]]
                    else:
                        spans.append([j, j + k, set(phrases[p])])
        out += [(d, w[a][0], w[b - 1][1], tuple(sorted(s))) for a, b, s in spans]
    return sorted(out)


def cut_spans(text, spans):
    out, last = "", 0
    for a, b in spans:
        out, last = out + text[last:a], b
    return out + text[last:]


@pytest.mark.parametrize("how", [{}, {"group_phrases": 40}, {"whole": True}])
def test_leaks(spark, how):
    """Exactly the brute-force spans, whatever the groups and whether or not the whole shard is indexed; cut until none is left."""
    r = random.Random(4)
    small = VOCAB[:60]
    items = [(i, " ".join(r.choices(small, k=r.choice([3, 6, 12, 30])))) for i in range(12)] + [(20, "one two three four five six seven eight")]
    texts = ["one two three one two three four five six seven eight four, five six seven eight", "One two. " * 3]
    for _ in range(60):
        t = r.choices(small, k=r.randint(0, 40))
        for _ in range(r.choice([0, 1, 1, 2])):
            w = r.choice(items)[1].upper().split()
            a = r.randint(0, len(w))
            t[r.randint(0, len(t)) : 0] = [", ".join(w[a:])] if w[a:] else []
        texts.append(" ".join(t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts + texts[:5])
    got = sorted((x.doc_id, x.start, x.end, tuple(x["items"])) for x in decontaminate.leaks(docs, bench, **how).collect())
    want = brute_leaks(texts + texts[:5], items)
    assert got == want and want
    clean = {x.doc_id: x.text for x in decontaminate.decontaminate(docs, bench, **how).collect()}
    assert brute_leaks(list(clean.values()), items) == []
    for d, t in enumerate(texts + texts[:5]):
        while spans := brute_leaks([t], items):
            t = cut_spans(t, [x[1:3] for x in spans])
        assert clean.get(d, "") == t or not t.strip() and d not in clean


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=5), max_size=3))
@settings(max_examples=80, deadline=None)
def test_cuts_leave_nothing(text, items):
    rows = {}
    for item in items:
        p, held = rows.setdefault(len(item), ([], []))
        p.append(common.scan([" ".join(map(str, item))])[0])
        held.append([1])
    phrases = decontaminate.Phrases({n: (np.unique(np.stack(p), axis=0), held[: len(np.unique(np.stack(p), axis=0))]) for n, (p, held) in rows.items()})
    text = " ".join(map(str, text))
    spans = phrases.cuts([text])[0]
    left = cut_spans(text, [s[:2] for s in spans])
    assert phrases.spans([left]) == [[]] and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_pii(spark):
    r = random.Random(9)
    planted, texts = [], []
    for i in range(200):
        t = prose(20, r).split()
        if i % 2:
            s = r.choice(["ana.smith@mail.example.com", "+1 (286) 555-5136", "70.23.22.57", "4539 1488 0343 6467", "123-45-6789", "GB82 WEST 1234 5698 7654 32"])
            t.insert(7, s)
            planted.append((i, s))
        texts.append(" ".join(t))
    texts += ["version 1.2.3.4 and 12.5 or 2019-10-11, 3 of 44", "a@b and x @ y", "sum 123456 of 99"]
    got = {(x.doc_id, texts[x.doc_id][x.start : x.end]) for x in pii.find_pii(frame(spark, texts)).collect()}
    assert set(planted) <= got
    assert {d for d, _ in got} <= {d for d, _ in planted} | {200}


def test_pii_candidates():
    """What any labeler votes for is proposed, joined numbers by every typed reading; nothing else is."""
    cases = {
        "Name: Priya Raghunathan lives": [("Priya Raghunathan", "name")], "Dear Zoë Müller-Lüdenscheidt, hi": [("Zoë Müller-Lüdenscheidt", "name")], "call 5551234567 now": [("5551234567", "phone")],
        "ssn 123456789 ok": [("123456789", "ssn")], "123-45-6789 987-65-4321": [("123-45-6789", "ssn"), ("987-65-4321", "ssn")], "123-45-6789 555-123-4567": [("123-45-6789", "ssn"), ("555-123-4567", "phone")],
        "2024-01-15 555-123-4567": [("555-123-4567", "phone")], "4539 1488 0343 6467 123-45-6789": [("4539 1488 0343 6467", "card"), ("123-45-6789", "ssn")], "Mr. Łukasz Żak": [("Łukasz Żak", "name")],
        "70.23.22.57": [("70.23.22.57", "ip")], "Die Kinder gehen nach Hause": [], "order 12345678": [], "sum 123456 of 99": [], "It was in March 2019-10-11": [],
    }
    for text, want in cases.items():
        got = {(text[a:b], pii.KINDS[k]) for a, b, k, *_ in pii.candidates(text)}
        assert set(want) <= got, text
        assert want or not got, text
    assert pii.candidates("1234567 " * 50_000 + "a@b.com ")[-1][2] == 0


@given(st.lists(st.tuples(st.sampled_from([0.5, 0.7, 0.9]), st.integers(0, 30), st.integers(1, 9), st.integers(0, 2)), max_size=14))
@settings(max_examples=150, deadline=None)
def test_pii_overlaps(rows):
    rows = [(p, a, a + n, k) for p, a, n, k in rows]
    taken = []
    for x in sorted(rows, key=lambda x: (-x[0], x[1] - x[2], x[3], x[1])):
        if all(x[2] <= y[1] or x[1] >= y[2] for y in taken):
            taken.append(x)
    assert pii.without_overlaps(rows) == sorted(taken, key=lambda x: x[1])


def brute_pii(texts, threshold=pii.THRESHOLD):
    """Votes row by row, a plain expectation-maximisation over the rows, and a logistic regression by small gradient steps."""
    rows = [(d, *c) for d, t in enumerate(texts) for c in pii.candidates(t)]
    n_l = len(pii.LABELERS)
    rel = {(k, j): 0.8 for k in range(len(pii.KINDS)) for j in range(n_l)}
    rate = dict.fromkeys(range(len(pii.KINDS)), 0.5)
    q = [0.5] * len(rows)
    for _ in range(pii.ROUNDS):
        for i, (_, _, _, k, votes, _) in enumerate(rows):
            odds = np.log(rate[k] / (1 - rate[k])) + sum(v * np.log(rel[k, j] / (1 - rel[k, j])) for j, v in enumerate(votes))
            q[i] = 1 / (1 + np.exp(-odds))
        for k in {r[3] for r in rows}:
            mine = [(p, r[4]) for p, r in zip(q, rows) if r[3] == k]
            for j in range(n_l):
                voted = sum(v[j] != 0 for _, v in mine)
                right = sum(p if v[j] > 0 else 1 - p for p, v in mine if v[j])
                scale = 1 + voted / 100
                rel[k, j] = min(0.99, max(0.05, (right + 8 * scale) / (voted + 10 * scale)))
            rate[k] = min(0.95, max(0.05, (sum(p for p, _ in mine) + 1) / (len(mine) + 2)))
    x = pii.design(np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows]))
    distinct, first, number = np.unique(np.concatenate([x, np.array(q)[:, None]], 1).round(12), axis=0, return_index=True, return_counts=True)
    w, n = np.zeros(x.shape[1]), number / number.mean()
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-np.clip(x[first] @ w, -30, 30)))
        w -= 0.02 / n.mean() / 8 * (x[first].T @ (n * (p - np.array(q)[first])) + 1e-2 * w)
    return {(d, a, b, pii.KINDS[k]): 1 / (1 + np.exp(-x[i] @ w)) for i, (d, a, b, k, _, _) in enumerate(rows)}


def test_pii_brute_force(spark):
    r = random.Random(3)
    kinds = ["ana.smith@mail.example.com", "a@b", "+1 (286) 555-5136", "70.23.22.57", "version 1.2.3.4", "4539 1488 0343 6467", "1111 2222 3333 4444", "123-45-6789", "000-45-6789", "Name: Priya Rao", "Anna Bell", "call 5551234567"]
    texts = [" ".join([prose(3, r), r.choice(kinds), prose(2, r), r.choice(kinds)]) for _ in range(120)]
    want = brute_pii(texts)
    got = {(x.doc_id, x.start, x.end, x.kind): x.probability for x in pii.find_pii(frame(spark, texts)).collect()}
    assert got and all(abs(want[k] - p) < 0.03 for k, p in got.items())
    sure = {}
    for (d, a, b, k), p in want.items():
        if p >= pii.THRESHOLD + 0.03:
            sure.setdefault(d, []).append((p, a, b, pii.KINDS.index(k)))
    assert all(any(e[0] == d and e[1] < b and a < e[2] for e in got) for d, spans in sure.items() for _, a, b, _ in spans)


def test_em_recovers_reliabilities():
    g = np.random.default_rng(0)
    truth = g.random(4000) < 0.6
    rel = [0.95, 0.8, 0.7, 0.75, 0.9]
    votes = np.stack([np.where(g.random(4000) < q, np.where(truth, 1, -1), np.where(truth, -1, 1)) * (g.random(4000) < 0.8) for q in rel], 1)
    p, reliability = pii.estimate(np.zeros(4000, int), votes, np.ones(4000))
    assert np.mean((p > 0.5) == truth) > 0.9
    assert np.abs(reliability[0] - rel).max() < 0.06


def brute_repeats(texts, width):
    words = [[(m.start(), m.end(), m.group().lower()) for m in common.WORD.finditer(t or "")] for t in texts]
    seen = collections.defaultdict(set)
    for d, w in enumerate(words):
        for k in range(len(w) - width + 1):
            seen[tuple(x[2] for x in w[k : k + width])].add(d)
    out = []
    for d, w in enumerate(words):
        spans = []
        for k in range(len(w) - width + 1):
            if len(seen[tuple(x[2] for x in w[k : k + width])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + width
                else:
                    spans.append([k, k + width])
        out += [(d, w[a][0], w[b - 1][1], b - a) for a, b in spans]
    return sorted(out)


def test_repeats(spark):
    r = random.Random(6)
    passages = [prose(n, r) for n in (50, 51, 55, 60, 80, 200)] + [" ".join(["de"] * 90)]
    texts = []
    for i in range(250):
        t = prose(r.randint(0, 150), r).split()
        for _ in range(r.choice([0, 1, 2])):
            t[r.randint(0, len(t)) : 0] = r.choice(passages).split()
        texts.append(", ".join(t) if i % 3 else " ".join(t).upper())
    texts += [texts[3], texts[4], "de " * 70, None, "", prose(49, r)]
    got = sorted((x.doc_id, x.start, x.end, x.n_words) for x in recompress.repeated_spans(frame(spark, texts)).collect())
    assert got == brute_repeats(texts, 50)


def test_repeats_long(spark):
    """Repeats far over any limit of a symbol: of one word, of distinct words, and of a page with a changed word."""
    r = random.Random(12)
    page, other = prose(3000, r).split(), prose(3000, r).split()
    texts = [" ".join(["same"] * 50_000), " ".join(["Same"] * 50_000), " ".join(page), " ".join(page[:1500] + ["changed"] + page[1501:]), " ".join(other[:700] + page[200:900] + other[700:]), " ".join(["a b"] * 30_000), " ".join(["a b"] * 20_000)]
    got = sorted((x.doc_id, x.start, x.end, x.n_words) for x in recompress.repeated_spans(frame(spark, texts)).collect())
    assert got == brute_repeats(texts, 50)
    assert [x[3] for x in got if x[0] < 2] == [50_000, 50_000]


def test_among(spark):
    """The filter loses no key and lets few others pass."""
    g = np.random.default_rng(1)
    keys = g.integers(-(2**63), 2**63, 3000)
    inside = spark.createDataFrame([(int(x),) for x in keys], "k long")
    may_be = recompress.among(inside, "k")
    others = spark.createDataFrame([(int(x),) for x in g.integers(-(2**63), 2**63, 3000)], "k long")
    assert inside.where(may_be("k")).count() == 3000 and others.where(may_be("k")).count() < 600
    assert inside.where(recompress.among(inside.limit(0), "k")("k")).count() == 0


def test_shared_rows_over_batches():
    import pyarrow as pa

    r = random.Random(7)
    for _ in range(200):
        rows = sorted((r.randint(0, 6), r.randint(0, 3), i) for i in range(r.randint(0, 30)))
        docs = collections.defaultdict(set)
        for h, d, _ in rows:
            docs[h].add(d)
        cuts = sorted(r.choices(range(len(rows) + 1), k=4))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in p], pa.int64()) for k in range(3)], ["h", "d", "i"]) for p in parts]
        got = sorted((x["d"], x["i"]) for b in recompress.shared_rows(iter(batches)) for x in b.to_pylist())
        assert got == sorted((d, i) for h, d, i in rows if len(docs[h]) > 1)
        got = sorted((x["d"], x["i"], x["first"]) for b in recompress.shared_rows(iter(batches), True) for x in b.to_pylist())
        assert got == sorted((d, i, d == min(docs[h])) for h, d, i in rows if len(docs[h]) > 1)


def test_rules(spark):
    docs = frame(spark, ["The cat is on the mat.", "A%%% b$$$ c### d&&&", "ALL CAPS HERE NOW", "x | y | z", "", None])
    assert {r.doc_id for r in rules.filter_documents(docs).select("doc_id").collect()} == {0}
    m = {r.doc_id: r for r in rules.measured(docs).collect()}
    assert m[0].n_words == 6 and m[0].stop_word_ratio == pytest.approx(4 / 6) and m[5].n_words == 0
    plan = rules.measured(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_stop_and_symbol_bounds(spark):
    """Long keyword lists without a stop word go, short texts without one stay, and symbols go from a fifth of the words on."""
    keywords = lambda n: " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    texts = [keywords(40), keywords(5), keywords(30) + " and the of", "the cat is here #a #b #c and so on", ""]
    assert {r.doc_id for r in rules.filter_documents(frame(spark, texts)).select("doc_id").collect()} == {1, 2}
