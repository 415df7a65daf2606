"""Queries without a SQL counterpart: scanners, detectors, folds, trainers, stores and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import language as L
from ..functions import tokenizer as T
from ..operators import crf, dataset, forge, models, ner, rules, spans, train
from ..operators import reduce as R
from ..scratch import materialize, new_path
from ..sources import io, store
from ..streaming import score
from .base import SCORES, line_spans, scores, table, texts
from .features import ORACLES as FEATURE_ORACLES
from .graph import TransformGraph
from .reductions import _SCORE_RULES, MATCHES, RULES, _gang


def _by_tag(df, key: str):
    """Tokens and characters by tag of an array of marks."""
    rows = df.select(key, F.explode("t").alias("t")).groupBy(key, F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum("t.length").alias("chars"))
    return rows.select(key, F.array(*[F.lit(t) for t in T.TAGS])[F.col("kind")].alias("tag"), "n", "chars")


def tokenize(spark, d):
    return _by_tag(texts(spark, d, "documents").select("doc_id", T.marks(F.col("text"), F.lit("PlainText")).alias("t")), "doc_id")


def html_tokenize(spark, d):
    return _by_tag(texts(spark, d, "pages").select("page_id", T.marks(F.col("html"), F.lit("HTML")).alias("t")), "page_id")


def tokenize_chain(spark, d):
    t = texts(spark, d, "conversations").select("conv_id", "turn", C.filter_tags(T.tokens(F.col("text"), F.lit("PlainText")), ["Word", "Punctuation", "URI"]).alias("t"))
    return t.select("conv_id", "turn", F.size("t").alias("n"))


def content_type_deep(spark, d):
    both = texts(spark, d, "pages").select(F.col("html").alias("content")).unionByName(texts(spark, d, "documents").select(F.col("text").alias("content")))
    plain = C.content_type(F.col("content"))
    return both.select(F.when(plain != "PlainText", plain).otherwise(T.sniff_column(F.col("content"))).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def language_detect(spark, d):
    docs = texts(spark, d)
    profiles = L.train_profiles(docs)
    found = docs.select("doc_id", "lang", L.detect(docs, F.col("text"), F.lit(False), profiles).alias("found"))
    return found.select("doc_id", "lang", L.language(F.lit(None).cast("string"), F.col("found")).alias("language"))


def lang_top3(spark, d):
    docs, pages = texts(spark, d), texts(spark, d, "pages")
    found = pages.select("page_id", L.html_hint(F.col("html")).alias("hint"), L.detect(pages, F.col("html"), F.lit(True), L.train_profiles(docs)).alias("found"))
    return found.select("page_id", "hint", F.posexplode("found").alias("place", "f")).select("page_id", "hint", "place", "f.language", F.round("f.score", 6).alias("score"))


SPAN_RULES = [("number", "/(?<number>[0-9]+)/", 0.8), ("word", "/th[a-z]+/", 0.4), ("licence", "license", 1.0), ("the", "the", 0.6)]


def span_rule_matches(spark, d):
    return rules.span_rule_matches(texts(spark, d, "documents"), SPAN_RULES)


def span_rules(spark, d):
    return spans.reduce_spans(span_rule_matches(spark, d), "rules")


def _unique(spark, d):
    s = line_spans(spark, d).select("doc_id", "label", "probability", "flags", F.col("offset"), F.col("length"))
    return s.withColumn("probability", F.col("probability") * 10)


def span_greedy(spark, d):
    return spans.reduce_spans(_unique(spark, d), "greedy")


def span_ensemble(spark, d):
    return spans.reduce_spans(_unique(spark, d).withColumn("flags", F.col("flags").bitwiseOR(F.lit(2))), "ensemble")


def kfold_assign(spark, d):
    return dataset.with_shuffled_fold(table(spark, d, "documents").select("doc_id"), 5)


def balance_binary(spark, d):
    p = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return dataset.balance_binary(p)


def _points(spark, d):
    l = table(spark, d, "labels")
    return l.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").cast("double").alias("y")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").cast("double").alias("y")))).alias("p")).select("doc_id", "p.*")


def _numeric(spark, d):
    """Length and mark ratios of labelled documents as dense vectors, y their quality."""
    t = F.col("text")
    n = F.greatest(F.length(t), F.lit(1))
    x = F.array(F.log(n), F.regexp_count(t, F.lit(r"[%$&#*]")) / n, F.regexp_count(t, F.lit(r"[A-Z]")) / n, F.regexp_count(t, F.lit(r"\|")) / n)
    docs = texts(spark, d).select("doc_id", x.alias("x"))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return models.dense_vectors(docs.join(labels, "doc_id").select("doc_id", "x", "y"), "x", "doc_id").join(labels, "doc_id")


def lr_simple(spark, d):
    p = _numeric(spark, d)
    return models.predict(models.train_simple(p), p).select("doc_id", "y", F.round("probability", 4).alias("probability"))


def lr_xval(spark, d):
    p = _numeric(spark, d)
    m = models.train_cross_validated(p, {"regParam": [0.001, 0.1], "elasticNetParam": [0.0]}, folds=3)
    return models.predict(m, p).select("doc_id", "y", F.round("probability", 4).alias("probability"))


def lr_holdout(spark, d):
    p = _numeric(spark, d)
    return models.predict(models.train_hold_out(p, {"regParam": [0.001, 0.1]}), p).select("doc_id", "y", F.round("probability", 4).alias("probability"))


def lr_multiclass(spark, d):
    e = models.dense_vectors(table(spark, d, "embeddings"), "embedding", "vec_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("double").alias("y")), "doc_id")
    classes = int(e.agg(F.max("y")).first()[0]) + 1
    w, b = models.train_multiclass(e, classes)
    return spark.createDataFrame([(k, b[k], float((w[k] ** 2).sum() ** 0.5)) for k in w], "class_id int, intercept double, norm double")


def _text(spark, d):
    return texts(spark, d).select("doc_id", "text")


def train_kbinary(spark, d):
    model = train.KBinary(train.Featurizer(1, 1, 2)).fit(_text(spark, d), _points(spark, d))
    return model.predict(_text(spark, d)).select("doc_id", "label", F.round("probability", 4).alias("probability"))


def train_multiclass(spark, d):
    docs = table(spark, d, "documents")
    points = docs.select("doc_id", F.col("lang").alias("label"), F.lit(1.0).alias("y"))
    model = train.MultiClass(train.Featurizer(1, 1, 5)).fit(docs.select("doc_id", "text"), points)
    return R.argmax_label(model.predict(docs.select("doc_id", "text"))).select("doc_id", "label")


def best_pipeline(spark, d):
    """AUROC of two feature pipelines for each label on held-out rows; the better one."""
    makers = {name: (lambda n=n: train.KBinary(train.Featurizer(n, n, 3))) for name, n in (("unigrams", 1), ("bigrams", 2))}
    return train.BestPipelines(makers).select(_text(spark, d), _points(spark, d)).select("label", "pipeline", F.round("auroc", 3).alias("auroc"))


def train_k_pipelines(spark, d):
    """Each label's model with the label's own best pipeline."""
    config = {"trainerConfig": {"jsonClass": "KClassKFPBuilder", "pipelines": {"unigrams": {"maxNgram": 1}, "bigrams": {"minNgram": 2, "maxNgram": 2, "minimumObservations": 3}}}}
    model = forge.from_config(config)().fit(_text(spark, d), _points(spark, d))
    return model.predict(_text(spark, d)).select("doc_id", "label", F.round("probability", 4).alias("probability"))


def train_configured(spark, d):
    """A trainer as its configuration describes it, cross-validated."""
    simple = {"jsonClass": "SimpleLogisticRegressionFurnaceBuilder", "maxIterations": 100, "regParam": [0.001], "tolerance": [1e-4], "elasticNetParam": [0.9]}
    inner = {"jsonClass": "KClass1FPBuilder", "dataGenBuilder": {"jsonClass": "KClassDataFrameGeneratorBuilder", "scale": {"jsonClass": "BalancedBinaryScaleBuilder", "tolerance": 0.1}}, "furnaceBuilder": simple, "pipeline": {"maxNgram": 1}}
    labelled = _text(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    out = forge.from_config({"trainerConfig": {"jsonClass": "CrossValidatingTrainerBuilder", "trainerBuilder": inner, "numFolds": 2}}).evaluate(labelled, _points(spark, d))
    return out.select("metric_type", "label", F.round("value", 3).alias("value"))


def model_roundtrip(spark, d):
    model = train.KBinary(train.Featurizer(1, 1, 2)).fit(_text(spark, d), _points(spark, d))
    path = new_path(spark, "model")
    store.save(model.tables(), path, task="classification.multiple")
    again = train.KBinary.from_tables(store.load(spark, path), least=1, most=1, minimum=2)
    return again.predict(_text(spark, d)).select("doc_id", "label", F.round("probability", 4).alias("probability"))


def training_stats(spark, d):
    model = train.KBinary(train.Featurizer(1, 1, 2)).fit(_text(spark, d), _points(spark, d))
    path = new_path(spark, "model")
    store.save(model.tables() | {"summaries": train.evaluate(model.predict(_text(spark, d)), _points(spark, d))}, path)
    return store.training_summaries(spark, path)


def rule_injection(spark, d):
    models_only = scores(spark, d).select("doc_id", "label", "probability", F.col("match_count").cast("long").alias("match_count"), "flags")
    fresh = rules.document_rule_scores(rules.document_rule_matches(table(spark, d, "documents"), RULES)).withColumn("match_count", F.col("match_count").cast("long"))
    out = R.gang_reduce(train.inject_rules(models_only, fresh))
    return out.select("doc_id", "label", "probability", F.col("match_count").cast("long").alias("match_count"), "flags")


def _sequences(spark, d):
    """Turns as sequences: a word's features are its first letter and its length, its tag whether it begins with th."""
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), C.words(F.col("text")).alias("w")).where("size(w) > 0")
    feats = F.transform("w", lambda w: F.array(F.ascii(w) % 64, 64 + F.least(F.length(w), F.lit(15)), 80 + F.ascii(F.substring(w, 2, 1)) % 64))
    tags = F.transform("w", lambda w: F.when(w.startswith("th"), "BX").otherwise("O"))
    return docs.select("doc_id", "w", feats.alias("features"), tags.alias("tags"))


def crf_decode(spark, d):
    seq = _sequences(spark, d)
    model = crf.train(seq.select("doc_id", "features", "tags"), 144, ["O", "BX", "IX"])
    out = seq.select("doc_id", "tags", crf.decode(seq, F.col("features"), model).alias("p"))
    rows = out.select("doc_id", F.posexplode(F.arrays_zip("tags", "p")).alias("pos", "z")).select("doc_id", "pos", F.col("z.tags").alias("gold"), F.col("z.p.tag").alias("tag"), F.col("z.p.confidence").alias("confidence"))
    return rows.groupBy("gold", "tag").agg(F.count("*").alias("n"))


NER_RULES = [("th", "/\\bth[a-z]+/", 0.9), ("number", "/[0-9]+/", 0.9)]


def _ner_data(spark, d):
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return docs, rules.span_rule_matches(docs, NER_RULES).select("doc_id", "label", "offset", "length")


def span_predict(spark, d):
    """A chain of tokens trained on annotated turns and used on all of them: spans with their offsets in the text."""
    docs, gold = _ner_data(spark, d)
    return ner.ChainNER().fit(docs, gold).predict(docs).select("doc_id", "label", "offset", "length", F.round("probability", 3).alias("probability"))


def span_forge(spark, d):
    """Span rules and a chain together, by configuration, measured by spans, tokens and tags on what was held out."""
    docs, gold = _ner_data(spark, d)
    furnaces = [{"name": "span_rules", "furnace": "SpanRuleFurnace", "config": {}}, {"name": "crf_ner", "furnace": "ChainNERFurnace", "config": {}}]
    make = forge.from_config({"forgeName": "BasicSpanForge", "forgeConfig": {"furnaces": furnaces, "rules": [["number", "/[0-9]+/", 0.9]]}})
    held, rest = dataset.random_holdout(docs, 0.3)
    out = train.train_and_evaluate(make, rest, held, gold, forge.evaluate_spans)
    return out.select("summary", "metric_type", "metric_class", "label", F.round("value", 3).alias("value"))


def offset_convert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("\U0001f600"), "text").alias("t"))
    o, n = C.to_utf16(F.col("t"), F.lit(1), F.lit(5))
    back, m = C.from_utf16(F.col("t"), F.col("o"), F.col("n"))
    return docs.withColumn("o", o).withColumn("n", n).select("doc_id", "o", "n", back.alias("offset"), m.alias("length"))


def w2v_bin_scan(spark, d):
    """The embeddings written as word vector files and read again."""
    path = new_path(spark, "vectors")
    io.write_word_vectors(table(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector")), path)
    back = io.read_word_vectors(spark, path)
    return back.select("word", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


def _ndjson(spark, d) -> str:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    ann = F.filter(F.array(F.struct(F.struct(F.lit("quality").alias("name")).alias("label"), (F.col("quality") == 1).alias("isPositive"))), lambda a: a["isPositive"].isNotNull())
    path = new_path(spark, "ndjson")
    docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), F.create_map(F.lit("iso_639_1"), F.col("lang")).alias("metadata"), ann.alias("annotations")).write.mode("overwrite").json(path)
    return path


def scan_ndjson_docs(spark, d):
    return io.read_documents(spark, _ndjson(spark, d)).select("name", F.length("content").alias("size"), F.col("metadata")["iso_639_1"].alias("lang"), F.size("annotations").alias("annotations"))


def scan_text_partitioned(spark, d):
    return io.read_text_documents(spark, _ndjson(spark, d), 8).select("name", F.length("content").alias("size"))


GRAPH = {
    "version": "0.0.1",
    "transforms": [{"name": n, "class": c, "config": k} for n, c, k in (("content", "ContentExtractor", {}), ("type", "ContentTypeDetector", {}), ("lang", "LanguageDetector", {}), ("tokens", "TokenTransformer", {}), ("bag", "BagOfWords", {"accept": ["Word", "Punctuation", "URI"], "transform": "ToLower"}), ("grams", "Ngrams", {"min": 1, "max": 2}))],
    "pipeline": [{"name": n, "inputs": i} for n, i in (("content", ["$document"]), ("type", ["$document"]), ("lang", ["$document", "type"]), ("tokens", ["content", "lang", "type"]), ("bag", ["tokens", "lang"]), ("grams", ["bag"]), ("$output", ["grams"]))],
}


def feature_graph(spark, d):
    docs = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("content"), F.create_map(F.lit("iso_639_1"), F.lit("en")).alias("metadata"))
    return TransformGraph(GRAPH).apply(docs).select("conv_id", "turn", F.size("grams").alias("n"))


def graph_vectors(spark, d):
    """A graph that ends in two terminals: TF-IDF values and counts side by side, dims turned back to features."""
    config = GRAPH | {"transforms": [*GRAPH["transforms"], {"name": "tfidf", "class": "TfIdfTransformer", "config": {"minimumObservations": 2}}, {"name": "index", "class": "IndexTransformer", "config": {"minimumObservations": 2}}]}
    config["pipeline"] = [*[p for p in GRAPH["pipeline"] if p["name"] != "$output"], {"name": "tfidf", "inputs": ["bag"]}, {"name": "index", "inputs": ["bag"]}, {"name": "$output", "inputs": ["tfidf", "index"]}]
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("content"), F.create_map(F.lit("iso_639_1"), F.lit("en")).alias("metadata"))
    graph = TransformGraph(config).prime(docs)
    v = graph.vectors(docs)
    sums = v.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.join(graph.invert(sums.select("dim")), "dim").select("dim", "feature", "n", "total")


def language_auto(spark, d):
    """Languages of documents that declare none, by the package's own profiles, in a feature graph."""
    config = {"version": "0.0.1", "transforms": [t for t in GRAPH["transforms"] if t["name"] in ("type", "lang")], "pipeline": [*[p for p in GRAPH["pipeline"] if p["name"] in ("type", "lang")], {"name": "$output", "inputs": ["lang"]}]}
    docs = texts(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.create_map(F.lit("iso_639_1"), F.lit(None).cast("string")).alias("metadata"))
    return TransformGraph(config).apply(docs).select("doc_id", "lang")


def sink_wide(spark, d):
    """Predictions as one row a document and a column a label, through CSV."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("source").alias("content"))
    path = new_path(spark, "wide")
    io.write_csv(io.wide_predictions(docs, scores(spark, d).where("model = 'm1' and label <> 'gamma'"), ["beta", "alpha", "gamma"]), path)
    return spark.read.option("header", True).schema("Name string, Content string, alpha double, beta double, gamma double").csv(path).select("Name", "Content", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "gamma")])


def sink_spans(spark, d):
    """Spans with their texts, through CSV."""
    docs = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.concat_ws("-", "conv_id", "turn").alias("name"), F.col("text").alias("content"))
    sp = docs.where("length(content) >= 9").select("doc_id", F.lit("head").alias("label"), F.lit(0.5).alias("probability"), F.lit(2).alias("offset"), F.lit(7).alias("length"))
    path = new_path(spark, "spans")
    io.write_csv(io.span_report(docs, sp), path)
    return io.read_csv(spark, path, "Name string, Span string, Label string, Confidence double, Offset int, Length int").select("Name", F.length("Span").alias("chars"), "Label", "Confidence", "Offset", "Length")


def sink_top(spark, d):
    """Each document's best label, through CSV."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    path = new_path(spark, "top")
    io.write_csv(io.top_report(docs, R.argmax_label(scores(spark, d).where("model = 'm1'"))), path)
    return spark.read.option("header", True).schema("Name string, Label string, Probability double").csv(path).select("Name", "Label", F.round("Probability", 6).alias("Probability"))


def sink_insights(spark, d):
    """Frequent n-grams, through CSV."""
    from .features import ngrams_window

    path = new_path(spark, "insights")
    counts = ngrams_window(spark, d).select(F.lit(2).alias("n"), F.col("n").alias("cnt"), F.concat_ws(" ", "word", "next").alias("ngram"))
    io.write_csv(io.insights_report(counts), path)
    return spark.read.option("header", True).schema("NGram int, Count long, Value string").csv(path)


def sink_points(spark, d):
    """Labelled points landed in a folder each model, twice, and read again."""
    path = new_path(spark, "points")
    for _ in range(2):
        io.land_points(_points(spark, d).withColumn("model_id", F.col("label")), path)
    return spark.read.parquet(path).groupBy("model_key", "label", "y").agg(F.count("*").alias("n"))


def stream_rule_score(spark, d):
    """Documents as a stream of files, scored by rules and landed: the rows of the batch."""
    docs = texts(spark, d, "documents").select("doc_id", "text")
    source = new_path(spark, "stream-in")
    docs.repartition(4).write.parquet(source)
    out = new_path(spark, "stream-out")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    score.land(score.score_rules(stream, RULES), out, new_path(spark, "stream-log"))
    return spark.read.parquet(out).select("doc_id", "label", "rule", "weight", "n")


QUERIES = {f.__name__: f for f in (
    tokenize, html_tokenize, tokenize_chain, content_type_deep, language_detect, lang_top3, span_rule_matches, span_rules, span_greedy, span_ensemble, kfold_assign, balance_binary, lr_simple, lr_xval, lr_holdout, lr_multiclass,
    train_kbinary, train_multiclass, train_k_pipelines, train_configured, best_pipeline, model_roundtrip, training_stats, rule_injection, crf_decode, span_predict, span_forge, offset_convert, w2v_bin_scan, scan_ndjson_docs, scan_text_partitioned,
    feature_graph, graph_vectors, language_auto, sink_wide, sink_spans, sink_top, sink_insights, sink_points, stream_rule_score,
)}

_HASH = lambda key: f"('0x' || substr(md5('42:' || {key}), 1, 15))::BIGINT"
ORACLES: dict[str, str] = {
    "kfold_assign": f"SELECT doc_id, CAST((row_number() OVER (ORDER BY {_HASH('doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents",
    "balance_binary": f"WITH p AS (SELECT doc_id, quality::DOUBLE AS y FROM labels), n AS (SELECT count(*) FILTER (WHERE y = 0) AS a, count(*) FILTER (WHERE y = 1) AS b FROM p) SELECT doc_id, y FROM p, n WHERE (least(a, b)::DOUBLE / greatest(a, b) >= 0.66) OR y = (CASE WHEN a <= b THEN 0 ELSE 1 END) OR {_HASH('doc_id')} % 1000000 < floor(1000000 * least(a, b)::DOUBLE / greatest(a, b))",
    "rule_injection": f"WITH {SCORES}, {MATCHES}, {_SCORE_RULES}, both_ AS (SELECT doc_id, label, probability, match_count, flags FROM rule_scores UNION ALL SELECT doc_id, label, probability, match_count, flags FROM scores WHERE (flags & 2) = 0), {_gang('both_')} SELECT doc_id, label, probability, match_count, flags FROM gang",
    "offset_convert": "SELECT doc_id, 2 AS o, CAST(5 + len(regexp_extract_all(substr(text, 1, 5), '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS n, 1 AS \"offset\", 5 AS length FROM documents",
    "w2v_bin_scan": "SELECT 'w' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings",
    "scan_ndjson_docs": "SELECT doc_id::VARCHAR AS name, CAST(length(text) AS INTEGER) AS size, lang, CAST(CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS INTEGER) AS annotations FROM documents LEFT JOIN labels USING (doc_id)",
    "scan_text_partitioned": "SELECT doc_id::VARCHAR AS name, CAST(length(text) AS INTEGER) AS size FROM documents LEFT JOIN labels USING (doc_id)",
    "sink_wide": f"WITH {SCORES} SELECT doc_id::VARCHAR AS \"Name\", source AS \"Content\", round(max(probability) FILTER (WHERE label = 'alpha'), 6) AS alpha, round(max(probability) FILTER (WHERE label = 'beta'), 6) AS beta, 0.0::DOUBLE AS gamma FROM scores JOIN documents USING (doc_id) WHERE model = 'm1' GROUP BY doc_id, source",
    "sink_spans": "SELECT conv_id || '-' || turn AS \"Name\", 7 AS chars, 'head' AS \"Label\", 0.5::DOUBLE AS \"Confidence\", 2 AS \"Offset\", 7 AS \"Length\" FROM conversations WHERE length(text) >= 9",
    "sink_top": f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY probability < 0.5, probability DESC, label) AS k FROM scores WHERE model = 'm1') SELECT doc_id::VARCHAR AS \"Name\", label AS \"Label\", round(probability, 6) AS \"Probability\" FROM r WHERE k = 1",
    "sink_points": "SELECT upper(left(sha1(label), 12)) AS model_key, label, y, 2 * count(*) AS n FROM (SELECT 'quality' AS label, quality::DOUBLE AS y FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) GROUP BY ALL",
    "stream_rule_score": f"WITH {MATCHES} SELECT doc_id, label, rule, weight, CAST(n AS INTEGER) AS n FROM matches",
}
ORACLES["sink_insights"] = f'SELECT 2 AS "NGram", n AS "Count", word || \' \' || next AS "Value" FROM ({FEATURE_ORACLES["ngrams_window"]})'
