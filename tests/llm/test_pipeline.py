"""The stages on the small tables, each against brute force on its own input."""

import duckdb
import pytest

import corpus_pipeline
from textloom.llm import common, queries, secrets, simhash

from test_operators import brute_groups, brute_leaks, cut_spans


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf, stages):
    start, good, single, clean, safe, mixed = map(rows, stages)
    labels = {r.doc_id: r.quality == 1 and r.toxic != 1 for r in common.table(spark, sf, "labels").collect()}
    assert sum((i in good) == q for i, q in labels.items()) >= 0.97 * len(labels)
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    texts = [r.text for r in good.values()]
    fp, has = simhash.fingerprints(texts)
    assert len(single) == len(set(brute_groups(fp, simhash.MAX_DISTANCE)[1]))
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    for i, r in single.items():
        text = r.text or ""
        while spans := brute_leaks([text], items):
            text = cut_spans(text, [x[1:3] for x in spans])
        assert (i in clean and clean[i].text == text and clean[i].n_chars == len(text)) or not text.strip()
    assert set(safe) == set(clean)
    assert all(not secrets.secrets_of(r.text) for r in safe.values())
    assert {r.doc_id for r in stages[-1].collect()} <= set(safe)
    assert [r.position for r in stages[-1].collect()] == sorted(r.position for r in stages[-1].collect())


EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "x" * 100_000), (5, "one two three four five"), (5, "one two three four five"), (None, "one two three four five"), (6, "a password = \"x9!Kd82jsPq\" here"), (7, "word " * 50_000), (8, "Ünï çødé \U0001f600")]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_edge_rows(spark, sf, name, stage):
    """Each stage on odd rows, with columns that clash with those it makes."""
    from pyspark.sql import functions as F

    extra = ["Score", "fp", "spans", "cut", "found", "key", "id_key", "epoch", "N_Tokens", "position", "mix", "bucket", "c0", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("own") for c in extra})
    out = stage(spark, docs, sf)
    rows = out.collect()
    if name == "mixing":
        assert out.columns == ["doc_id", "source", "epoch", "n_tokens", "position", "text", "lang", "n_chars", "Score", "fp", "spans", "cut", "found", "key", "id_key", "_epoch", "_N_Tokens", "_position", "mix", "bucket", "c0", "a.b"]
        assert {r.text for r in rows} == {t for _, t in EDGE if (t or "").strip()}
        assert all(r["_epoch"] == r["_position"] == r["a.b"] == "own" for r in rows)
        return
    assert out.columns == docs.columns and all(r["a.b"] == r.epoch == "own" for r in rows)
    texts = sorted((r.text or "" for r in rows))
    if name == "simhash_near_dedup":
        assert len(rows) == len(EDGE) - 2 and sum(t.startswith("one") for t in texts) == 1
    elif name == "secret_scan":
        assert texts == sorted((t or "").replace("x9!Kd82jsPq", "[SECRET]") for _, t in EDGE)
    elif name == "benchmark_decontamination":
        assert texts == sorted(t or "" for _, t in EDGE)
    else:
        assert set(texts) <= {t or "" for _, t in EDGE}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, sf, name, stage):
    docs = common.table(spark, sf, "documents").limit(0)
    out = stage(spark, docs, sf)
    assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)


def test_tables_are_removed(spark, sf):
    """Of a run only what its result still reads is left."""
    before = common.written()
    out = corpus_pipeline.run(spark, sf)
    left = common.written() - before
    assert out.count() > 0 and sorted(p.rsplit("/", 1)[1].split("-")[1] for p in left) == ["secret_scan", "totals"]
    common.forget(before)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    fix = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(fix, df.select(*names).collect()), key=repr) == sorted(map(fix, want.fetchall()), key=repr)
