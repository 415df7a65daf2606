"""Queries of the feature operators: words, shapes, grams, neighbourhoods, stop words, sources and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import indexing as I
from ..operators import metrics
from .base import TOKS, W_SQL, documents, table, texts

STOPS = {
    "en": "the and of to in is it that for on with as was by are be this an a or from at",
    "fr": "le la les de des et un une du en que qui est au aux il elle pour dans par sur",
    "de": "der die das und ist von zu den dem ein eine mit auf für im des nicht es an auch",
    "es": "el la los las de y que en un una es se no del al por con su para lo",
}
STOP_SQL = "stops(lang, word) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, v in STOPS.items() for w in v.split()) + ")"


def insights_ngram_counts(spark, d):
    grams = I.gram_rows(documents(spark, d), "w", [[0], [0, 1], [0, 1, 2]])
    rows = grams.groupBy((F.col("pick") + 1).alias("n"), F.col("gram").alias("ngram")).agg(F.count("*").alias("cnt"))
    return rows.where("cnt >= 4").orderBy(F.desc("n"), F.desc("cnt"), "ngram")


def bag_of_words(spark, d):
    return documents(spark, d).select("doc_id", F.explode_outer("w").alias("word")).where("word is not null").groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def chain_bag_of_words(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", F.coalesce(F.regexp_extract_all("text", F.lit(C.WORDS), F.lit(0)), F.array().cast("array<string>")).alias("w"))
    chain = docs.select("doc_id", F.posexplode_outer(F.transform("w", lambda x: C.change_case(x, "ToLower"))).alias("pos", "word")).where("word is not null")
    return chain.groupBy("pos", "word").agg(F.count("*").alias("n"))


def scan_parquet_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def content_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


def union_doc_chunks(spark, d):
    chunks = [table(spark, d, "documents").select(F.lit("documents").alias("chunk"), F.col("doc_id").alias("id"), F.length("text").alias("size"))]
    chunks.append(table(spark, d, "benchmark").select(F.lit("benchmark").alias("chunk"), F.col("item_id").alias("id"), F.length("text").alias("size")))
    chunks.append(table(spark, d, "conversations").select(F.lit("conversations").alias("chunk"), F.col("conv_id").alias("id"), F.length("text").alias("size")))
    return metrics.union_all(chunks)


def content_type(spark, d):
    both = texts(spark, d, "pages").select(F.col("html").alias("content")).unionByName(texts(spark, d, "documents").select(F.col("text").alias("content")))
    return both.groupBy(C.content_type(F.col("content")).alias("type")).agg(F.count("*").alias("n"))


def language_normalize(spark, d):
    return table(spark, d, "documents").groupBy(C.normalize_language(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


def json_props_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def ngrams(spark, d):
    grams = I.gram_rows(documents(spark, d), "w", [[0, 1], [0, 1, 2]], ("lang",), "\u0001")
    counts = grams.groupBy("lang", (F.col("pick") + 2).alias("n"), "gram").agg(F.count("*").alias("c"))
    return counts.groupBy("lang", "n").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))


def ngrams_arrays(spark, d):
    """The same grams as arrays, a document at a time: how many, and how many items."""
    docs = documents(spark, d).select("doc_id", C.ngrams(F.col("w"), 2, 3).alias("g"), C.skipgrams(F.col("w"), 1, 2).alias("s"))
    return docs.select("doc_id", F.size("g").alias("grams"), F.aggregate("g", F.lit(0), lambda a, x: a + F.size(x)).alias("items"), F.size("s").alias("skipgrams"))


def ngrams_window(spark, d):
    # a document's words are in one row already: pairs come from the array, not from a sorted window
    grams = I.gram_rows(documents(spark, d), "w", [[0, 1]]).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 4")
    pair = F.split("gram", " ")
    return grams.select(pair[0].alias("word"), pair[1].alias("next"), "n")


def skipgrams(spark, d):
    grams = I.gram_rows(documents(spark, d), "w", [[0, 1], [0, 2], [0, 3]])
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 4")


def word_shapes(spark, d):
    words = texts(spark, d, "documents").select(F.explode_outer(F.regexp_extract_all("text", F.lit(C.SHAPE_TOKENS), F.lit(0))).alias("word")).where("word is not null")
    # equal words have equal shapes: the cascade runs on distinct words
    return words.groupBy("word").agg(F.count("*").alias("n")).groupBy(C.word_shape(F.col("word")).alias("shape")).agg(F.sum("n").alias("n"))


def lift(spark, d):
    docs = table(spark, d, "documents").select("doc_id", C.lift(F.col("lang"), F.col("source")).alias("features"))
    return docs.select("doc_id", F.array_join("features", "|").alias("features"))


def chain_lift(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", C.chain_lift(F.array("role"), F.array(F.length("text").cast("string")))[0].alias("features"))
    return turns.select("conv_id", "turn", F.array_join("features", "|").alias("features"))


def chain_neighborhood(spark, d):
    chains = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("chain"))
    near = chains.select("conv_id", F.col("chain.turn").alias("turns"), C.chain_neighborhood(F.col("chain.role"), 1, 1).alias("near"))
    rows = near.select("conv_id", F.explode(F.arrays_zip("turns", "near")).alias("z")).select("conv_id", F.col("z.turns").alias("turn"), F.explode("z.near").alias("f"))
    return rows.select("conv_id", "turn", F.col("f.offset").cast("int").alias("distance"), F.col("f.feature").alias("role"))


def _stops(spark):
    return spark.createDataFrame([(k, w) for k, v in STOPS.items() for w in v.split()], "lang string, word string")


def stopword_anti_join(spark, d):
    words = documents(spark, d).select("lang", F.explode_outer("w").alias("word")).where("word is not null").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return words.join(F.broadcast(_stops(spark)), ["lang", "word"], "left_anti")  # a fixed list


def stopword_filter(spark, d):
    lists = F.create_map(*[x for k, v in STOPS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    docs = documents(spark, d).select("doc_id", F.size("w").alias("before"), C.drop_stopwords(F.col("w"), F.try_element_at(lists, F.col("lang"))).alias("kept"))
    return docs.select("doc_id", "before", F.size("kept").alias("after"))


def filter_token_tags(spark, d):
    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+|\s+"), F.lit(0)), lambda t: F.struct(t.alias("content"), F.when(t.rlike(r"^\s"), "Whitespace").when(t.rlike(r"^[\p{L}\p{N}]"), "Word").otherwise("Punctuation").alias("tag")))
    docs = texts(spark, d, "documents").select("doc_id", tokens.alias("tokens"))
    return docs.select("doc_id", *[F.size(C.filter_tags(F.col("tokens"), a)).alias(n) for n, a in (("words", ["Word"]), ("marks", ["Punctuation"]), ("visible", ["Word", "Punctuation"]))])


def filter_label(spark, d):
    return table(spark, d, "labels").where("quality = 1").select("doc_id", "toxic")


def drop_empty_vectors(spark, d):
    words = documents(spark, d).where(F.exists("w", lambda x: x.startswith("th")))
    return words.select("doc_id", F.size(F.filter("w", lambda x: x.startswith("th"))).alias("active"))


def distinct_docs(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def sha1_name(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", C.sha1_name(F.col("source")).alias("name"))


def label_translate(spark, d):
    from ..operators.reduce import translate_labels

    n = table(spark, d, "nation").select(F.col("n_name").alias("item"), F.col("n_regionkey").cast("string").alias("label"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("uuid"), F.col("r_name").alias("name")).where("uuid <> '3'")
    return translate_labels(n, r).select("item", "label", "name")


def flag_mask(spark, d):
    from .base import scores

    g = scores(spark, d).groupBy("doc_id").agg(F.bit_or("flags").alias("flags"))
    return g.select("doc_id", "flags", C.has_flag(F.col("flags"), C.FORCED).alias("forced"), C.has_flag(F.col("flags"), C.RULE).alias("rule"))


QUERIES = {f.__name__: f for f in (
    insights_ngram_counts, bag_of_words, chain_bag_of_words, scan_parquet_documents, content_extract, union_doc_chunks, content_type, language_normalize, json_props_extract, ngrams, ngrams_arrays, ngrams_window,
    skipgrams, word_shapes, lift, chain_lift, chain_neighborhood, stopword_anti_join, stopword_filter, filter_token_tags, filter_label, drop_empty_vectors, distinct_docs, sha1_name, label_translate, flag_mask,
)}

_SHAPE = "word"
for _p, _t in ((r"\p{Lu}", "C"), ("CC+", "CC"), (r"\p{Ll}", "c"), ("cc+", "cc"), (r"\p{Nd}", "n"), ("nn+", "nn"), (r"\p{Zs}+", "s"), ("[^snCc]+", "p")):
    _SHAPE = f"regexp_replace({_SHAPE}, '{_p}', '{_t}', 'g')"

_GRAMS = "SELECT {n} AS n, {cols} AS ngram FROM (SELECT word, {leads}, doc_id FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE {last} IS NOT NULL"


def _gram(n: int) -> str:
    leads = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(1, n)) or "pos"
    cols = " || ' ' || ".join(["word", *[f"w{i}" for i in range(1, n)]])
    return _GRAMS.format(n=n, cols=cols, leads=leads, last=f"w{n - 1}" if n > 1 else "word")


ORACLES = {
    "insights_ngram_counts": f"WITH {TOKS}, g AS ({_gram(1)} UNION ALL {_gram(2)} UNION ALL {_gram(3)}) SELECT n, ngram, count(*) AS cnt FROM g GROUP BY n, ngram HAVING count(*) >= 4",
    "bag_of_words": f"WITH {TOKS} SELECT doc_id, word, count(*) AS tf FROM toks GROUP BY ALL",
    "chain_bag_of_words": r"SELECT CAST(pos AS INTEGER) AS pos, word, count(*) AS n FROM (SELECT lower(unnest(w)) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents)) GROUP BY ALL",
    "scan_parquet_documents": "SELECT doc_id, lang, source, n_chars FROM documents",
    "content_extract": "SELECT doc_id, text AS content FROM documents",
    "union_doc_chunks": "SELECT 'documents' AS chunk, doc_id AS id, CAST(length(text) AS INTEGER) AS size FROM documents UNION ALL SELECT 'benchmark', item_id, CAST(length(text) AS INTEGER) FROM benchmark UNION ALL SELECT 'conversations', conv_id, CAST(length(text) AS INTEGER) FROM conversations",
    "content_type": "SELECT CASE WHEN lower(left(content, 10)) = '<!doctype ' THEN 'HTML' WHEN lower(left(content, 6)) = '<?xml ' THEN 'XML' ELSE 'PlainText' END AS type, count(*) AS n FROM (SELECT html AS content FROM pages UNION ALL SELECT text FROM documents) GROUP BY ALL",
    "language_normalize": "SELECT CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END AS language, count(*) AS n FROM documents GROUP BY ALL",
    "json_props_extract": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY ALL",
    "ngrams": f"WITH {TOKS}, g AS (SELECT lang, word, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT lang, 2 AS n, count(*) AS total, count(DISTINCT word || chr(1) || w1) AS kinds FROM g WHERE w1 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 3, count(*), count(DISTINCT word || chr(1) || w1 || chr(1) || w2) FROM g WHERE w2 IS NOT NULL GROUP BY ALL",
    "ngrams_arrays": f"SELECT doc_id, CAST(greatest(n - 1, 0) + greatest(n - 2, 0) AS INTEGER) AS grams, CAST(2 * greatest(n - 1, 0) + 3 * greatest(n - 2, 0) AS INTEGER) AS items, CAST(greatest(n - 1, 0) + greatest(n - 2, 0) AS INTEGER) AS skipgrams FROM (SELECT doc_id, coalesce(len({W_SQL}), 0) AS n FROM documents)",
    "ngrams_window": f"WITH {TOKS} SELECT word, next, count(*) AS n FROM (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM toks) WHERE next IS NOT NULL GROUP BY ALL HAVING count(*) >= 4",
    "skipgrams": f"WITH {TOKS}, g AS (SELECT word, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT gram, count(*) AS n FROM (SELECT word || ' ' || unnest([w1, w2, w3]) AS gram FROM g) WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) >= 4",
    "word_shapes": rf"SELECT {_SHAPE} AS shape, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{P}}]+')) AS word FROM documents) GROUP BY ALL",
    "lift": "SELECT doc_id, concat_ws('|', lang, source) AS features FROM documents",
    "chain_lift": "SELECT conv_id, turn, concat_ws('|', CAST(length(text) AS VARCHAR), role) AS features FROM conversations",
    "chain_neighborhood": "WITH n AS (SELECT conv_id, turn, lag(role) OVER o AS p, lead(role) OVER o AS q FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, -1 AS distance, p AS role FROM n WHERE p IS NOT NULL UNION ALL SELECT conv_id, turn, 1, q FROM n WHERE q IS NOT NULL",
    "stopword_anti_join": f"WITH {TOKS}, {STOP_SQL} SELECT lang, word, count(*) AS n FROM toks WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = toks.lang AND s.word = toks.word) GROUP BY ALL",
    "stopword_filter": f"WITH {TOKS}, {STOP_SQL}, k AS (SELECT doc_id, count(*) AS b, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = toks.lang AND s.word = toks.word)) AS a FROM toks GROUP BY doc_id) SELECT d.doc_id, CAST(coalesce(b, 0) AS INTEGER) AS before, CAST(coalesce(a, 0) AS INTEGER) AS after FROM documents d LEFT JOIN k USING (doc_id)",
    "filter_token_tags": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(text, '[^\p{L}\p{N}\s]+')) AS INTEGER) AS marks, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+')) + len(regexp_extract_all(text, '[^\p{L}\p{N}\s]+')) AS INTEGER) AS visible FROM documents",
    "filter_label": "SELECT doc_id, toxic FROM labels WHERE quality = 1",
    "drop_empty_vectors": f"WITH {TOKS} SELECT doc_id, CAST(count(*) AS INTEGER) AS active FROM toks WHERE starts_with(word, 'th') GROUP BY doc_id",
    "distinct_docs": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "sha1_name": "SELECT DISTINCT source, upper(left(sha1(source), 12)) AS name FROM documents",
    "label_translate": "SELECT n_name AS item, CAST(n_regionkey AS VARCHAR) AS label, r_name AS name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON r_regionkey = n_regionkey",
}
from .base import SCORES  # noqa: E402

ORACLES["flag_mask"] = f"WITH {SCORES} SELECT doc_id, flags, (flags & 1) <> 0 AS forced, (flags & 2) <> 0 AS rule FROM (SELECT doc_id, bit_or(flags) AS flags FROM scores GROUP BY doc_id)"
