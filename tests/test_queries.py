"""Registered queries on the small tables: SQL counterparts by DuckDB, the rest by a run."""

import os

import duckdb
import pytest

from textloom.plans import catalogue, engines
from textloom.sources import io

SQL = catalogue.oracle_sql()
SLOW = {"train_k_pipelines", "model_roundtrip", "training_stats", "train_multiclass", "lr_xval", "lr_holdout"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


def fix(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(fix, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, con, name):
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    df = catalogue.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    got = df.select(*[f"`{n}`" for n in names]).collect()
    assert sorted((fix(tuple(r)) for r in got), key=repr) == sorted((fix(r) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(engines.QUERIES) - SLOW - set(SQL)))
def test_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_sink_spans_odd_texts(spark, tmp_path):
    """Line ends, quotes and zeros in a span stay in its row; no document is taken for another one."""
    texts = ["a plain text", "eit.\nUndso", "one\r\ntwo\rx", 'say "\x00" so', '\\"\n,"\x00,\n', "ab  trail  ", "\n\n\n\n\n\n\n\n\n", "too few", None]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn integer, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?)", [(1, 1000 * (i == 1) + i, t) for i, t in enumerate(texts)] + [(2, 1, "other conversation")])
    con.execute(f"copy conversations to '{tmp_path}/conversations.parquet' (format parquet)")
    want = con.execute(SQL["sink_spans"])
    names = [c[0] for c in want.description]
    got = catalogue.queries()["sink_spans"](spark, str(tmp_path)).select(*[f"`{n}`" for n in names]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    odd = [(i, t[2:9]) for i, t in enumerate(texts) if t and len(t) >= 9]
    io.write_csv(spark.createDataFrame(odd, "i int, t string"), str(tmp_path / "csv"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "csv"), "i int, t string").collect())) == odd


def test_offset_convert_short_texts(spark, tmp_path):
    """Spans are clipped to the text, and one that begins where the text ends has its offset and no length."""
    texts = {1: "", 2: "A.", 3: "Von.", 4: "Éaux.", 5: "a\U0001f600", 6: "\U0001f600" * 9, 7: "longer text"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.o, r.n, r.offset, r.length) for r in catalogue.queries()["offset_convert"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0, 0, 0), 2: (2, 2, 1, 2), 3: (2, 4, 1, 4), 4: (2, 5, 1, 5), 5: (2, 3, 1, 2), 6: (2, 10, 1, 5), 7: (2, 5, 1, 5)}
