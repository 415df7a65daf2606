"""Queries of rules, reductions, spans, tags, metrics and data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import dataset as D
from ..operators import metrics as M
from ..operators import reduce as R
from ..operators import rules as RU
from ..operators import spans as S
from ..operators import train as TR
from .base import SCORES, SPANS, TOKS, documents, line_spans, scores, table, texts

RULES = [("alpha", "the", 0.7), ("alpha", "license", 1.0), ("beta", "/[0-9]+/", 0.4), ("beta", "idiot", 0.0), ("gamma", "/th[a-z]+/", 0.6), ("gamma", "%%%", 0.0), ("bad", "weight", 1.5), ("bad", "/(unclosed/", 0.5)]
_PATTERNS = [("alpha", "the", 0.7, "(?i)the"), ("alpha", "license", 1.0, "(?i)license"), ("beta", "/[0-9]+/", 0.4, "[0-9]+"), ("beta", "idiot", 0.0, "(?i)idiot"), ("gamma", "/th[a-z]+/", 0.6, "th[a-z]+"), ("gamma", "%%%", 0.0, "%%%")]
MATCHES = "matches AS (" + " UNION ALL ".join(f"SELECT doc_id, '{l}' AS label, '{e}' AS rule, {w!r}::DOUBLE AS weight, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE len(regexp_extract_all(text, '{p}')) > 0" for l, e, w, p in _PATTERNS) + ")"
THRESHOLDS = [("alpha", 0.6), ("beta", 0.3)]
_TH = "th(label, threshold) AS (VALUES ('alpha', 0.6::DOUBLE), ('beta', 0.3::DOUBLE))"


def _matches(spark, d):
    return RU.document_rule_matches(texts(spark, d), RULES)


def doc_rule_matches(spark, d):
    return _matches(spark, d).select("doc_id", "label", "rule", "weight", "n")


def doc_rule_score(spark, d):
    s = RU.document_rule_scores(_matches(spark, d))
    return s.select("doc_id", "label", F.round("probability", 6).alias("probability"), F.col("match_count").cast("long").alias("match_count"), "flags")


def valid_rules(spark, d):
    kept = RU.valid_rules(spark, RULES[:7])
    return spark.createDataFrame([(l, e, float(w)) for l, e, w in kept], "label string, expression string, weight double")


def rules_by_label(spark, d):
    rules = spark.createDataFrame([(l, e, float(w)) for l, e, w in RULES], "label string, expression string, weight double")
    return RU.rules_by_label(rules).select("label", F.array_join("rules.expression", " ").alias("expressions"))


def weighted_average(spark, d):
    g = scores(spark, d).groupBy("doc_id", "label").agg(R.weighted_average(F.col("probability"), F.col("match_count")).alias("p"))
    return g.select("doc_id", "label", F.round("p", 6).alias("probability"))


def gang_reduce(spark, d):
    g = R.gang_reduce(scores(spark, d))
    return g.select("doc_id", "label", F.round("probability", 6).alias("probability"), F.col("match_count").cast("long").alias("match_count"), "flags")


def gang_predict(spark, d):
    """Rules and models over one corpus, reduced, best label first."""
    rules = RU.document_rule_scores(_matches(spark, d)).withColumn("match_count", F.col("match_count").cast("long"))
    models = scores(spark, d).where("model <> 'rules'").select("doc_id", "label", "probability", F.col("match_count").cast("long").alias("match_count"), "flags")
    g = R.gang_reduce(rules.unionByName(models)).withColumn("probability", F.round("probability", 6))
    return R.ranked(g).select("doc_id", F.posexplode("predictions").alias("place", "p")).select("doc_id", "place", "p.label", "p.probability")


def forced_filter(spark, d):
    return R.forced_only(scores(spark, d), ["doc_id", "label"]).select("doc_id", "label", "model", "flags")


def argmax_label(spark, d):
    th = spark.createDataFrame(THRESHOLDS, "label string, threshold double")
    g = R.argmax_label(scores(spark, d).where("model = 'm1'"), th, 0.5)
    return g.select("doc_id", "label", F.round("probability", 6).alias("probability"))


def threshold_filter(spark, d):
    th = spark.createDataFrame(THRESHOLDS, "label string, threshold double")
    return R.over_threshold(scores(spark, d), th, 0.5).select("doc_id", "model", "label")


def sort_predictions(spark, d):
    g = R.ranked(scores(spark, d).where("model = 'm2'"))
    return g.select("doc_id", F.array_join("predictions.label", " ").alias("labels"))


def model_validate(spark, d):
    """Stored against fresh predictions: m1 against m1 with each 50th document's probability moved."""
    a = scores(spark, d).where("model = 'm1'")
    b = a.withColumn("probability", F.when(F.col("doc_id") % 50 == 0, F.col("probability") + 0.01).otherwise(F.col("probability")))
    return R.close_enough(a, b, ["doc_id", "label"])


def suggested_thresholds(spark, d):
    by = lambda m: scores(spark, d).where(F.col("model") == m).groupBy("label").agg(F.max("match_count").cast("double").alias("threshold"))
    return R.suggested_thresholds(by("m1").where("label <> 'beta'"), by("m2"))


def has_overlaps(spark, d):
    return S.overlapping_pairs(line_spans(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.max(F.col("overlaps").cast("int")).alias("has_overlaps"))


def span_islands(spark, d):
    return S.islands(line_spans(spark, d), ["doc_id"]).groupBy("doc_id", "island").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("n"))


def span_union_avg(spark, d):
    u = S.union_average(line_spans(spark, d), ["doc_id"])
    return u.select("doc_id", "label", F.round("probability", 6).alias("probability"), "flags", "offset", "length")


def annotation_overlap(spark, d):
    s = line_spans(spark, d).where("length > 0")
    a = s.where("label = 'A'").select("doc_id", F.col("offset").alias("ao"), F.col("length").alias("al"))
    b = s.where("label <> 'A'").select(F.col("doc_id").alias("d2"), F.col("offset").alias("bo"), F.col("length").alias("bl"))
    j = a.join(b, (F.col("doc_id") == F.col("d2")) & S.contains_token(F.col("ao"), F.col("al"), F.col("bo"), F.col("bl")))
    return j.select("doc_id", "ao", "bo")


def filter_annotations(spark, d):
    return line_spans(spark, d).where("length > 20 and label <> ''").groupBy("label").agg(F.count("*").alias("n"))


def _tags(spark, d):
    """Tags from words: th- begins a span, s- and o- words go on."""
    docs = documents(spark, d).select("doc_id", F.posexplode_outer("w").alias("pos", "word")).where("word is not null")
    tag = F.when(F.col("word").startswith("th"), "BX").when(F.col("word").rlike("^[so]"), "IX").otherwise("O")
    return docs.select("doc_id", "pos", tag.alias("tag"), (F.length("word") % 7 / 7.0).alias("confidence"), (F.col("pos") * 10).alias("offset"), F.least(F.length("word"), F.lit(9)).alias("length"))


def bio_assemble(spark, d):
    s = S.assemble_bio(_tags(spark, d), ["doc_id"])
    return s.select("doc_id", "label", "start", "end", "n", F.round("probability", 6).alias("probability"))


def bio_parse(spark, d):
    return _tags(spark, d).groupBy(C.bio_kind(F.col("tag")).alias("kind"), C.bio_label(F.col("tag")).alias("label")).agg(F.count("*").alias("n"))


def _tokens_and_annotations(spark, d):
    tokens = documents(spark, d).select("doc_id", F.posexplode_outer("w").alias("pos", "word")).where("word is not null").select("doc_id", "pos", (F.col("pos") * 10).alias("offset"), F.lit(9).alias("length"))
    docs = table(spark, d, "documents").select("doc_id")
    ann = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("P").alias("label"), F.lit(15).alias("offset"), F.lit(20).alias("length")), F.struct(F.lit("Q").alias("label"), (F.lit(60) + F.col("doc_id") % 10).cast("int").alias("offset"), F.lit(25).alias("length")))).alias("a")).select("doc_id", "a.*")
    return tokens, ann


def bio_tagging(spark, d):
    tags = S.tag_bio(*_tokens_and_annotations(spark, d))
    return tags.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def gold_span_align(spark, d):
    tokens, ann = _tokens_and_annotations(spark, d)
    return S.align_to_tokens(ann, tokens)


def _gold_predicted(spark, d):
    s = line_spans(spark, d)
    gold = s.where("l_partkey % 3 <> 0").select("doc_id", "label", "offset", "length")
    return gold, s.where("l_suppkey % 4 <> 0").select("doc_id", "label", "offset", "length")


def span_exact_match(spark, d):
    gold, predicted = _gold_predicted(spark, d)
    return predicted.join(gold, ["doc_id", "label", "offset", "length"], "left_semi").groupBy("label").agg(F.count("*").alias("n"))


def _rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def span_prf(spark, d):
    gold, predicted = _gold_predicted(spark, d)
    out = M.prf_by_label(M.span_counts(gold, predicted, ["doc_id", "offset", "length"]))
    return _rounded(out, "precision", "recall", "f1")


def _predicted_annotations(spark, d):
    """The gold annotations, P moved by 12 characters, Q only on even documents."""
    tokens, ann = _tokens_and_annotations(spark, d)
    moved = ann.withColumn("offset", F.when(F.col("label") == "P", F.col("offset") + 12).otherwise(F.col("offset"))).where("label = 'P' or doc_id % 2 = 0")
    return tokens, ann, moved


def token_match_prf(spark, d):
    """Token by token: labels of the spans that cover them."""
    tokens, gold, predicted = _predicted_annotations(spark, d)
    g, p = (S.tag_bio(tokens, x).where("tag <> 'O'").select("doc_id", "pos", C.bio_label(F.col("tag")).alias("label")) for x in (gold, predicted))
    return _rounded(M.prf_by_label(M.span_counts(g, p, ["doc_id", "pos"])), "precision", "recall", "f1")


def token_tag_prf(spark, d):
    """The same with the B and I tags."""
    tokens, gold, predicted = _predicted_annotations(spark, d)
    g, p = (S.tag_bio(tokens, x).where("tag <> 'O'").select("doc_id", "pos", F.col("tag").alias("label")) for x in (gold, predicted))
    return _rounded(M.prf_by_label(M.span_counts(g, p, ["doc_id", "pos"])), "precision", "recall", "f1")


def _pairs(spark, d):
    """Language against a prediction that is wrong on each fifth document."""
    docs = table(spark, d, "documents")
    wrong = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")
    return docs.select(F.col("lang").alias("gold"), F.when(F.col("doc_id") % 5 == 0, wrong).otherwise(F.col("lang")).alias("predicted"))


def eval_confusion(spark, d):
    return M.confusion(_pairs(spark, d))


def prf_by_label(spark, d):
    return _rounded(M.prf_by_label(M.counts_by_label(_pairs(spark, d))), "precision", "recall", "f1")


def micro_macro_prf(spark, d):
    m = M.micro_macro(M.counts_by_label(_pairs(spark, d)))
    return _rounded(m, *m.columns)


def multiclass_metrics(spark, d):
    return _rounded(M.multiclass(_pairs(spark, d)), "value")


def _sets(spark, d):
    l = table(spark, d, "labels")
    gold = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    predicted = F.filter(F.array(F.when(F.col("doc_id") % 7 != 0, "quality"), F.when(F.col("doc_id") % 3 == 0, "toxic")), lambda x: x.isNotNull())
    return l.select(gold.alias("gold"), predicted.alias("predicted"))


def multilabel_metrics(spark, d):
    m = M.multilabel(_sets(spark, d), 2)
    return _rounded(m, *m.columns)


def multilabel_by_label(spark, d):
    return _rounded(M.multilabel_by_label(_sets(spark, d)), "precision", "recall", "f1")


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return table(spark, d, "labels").join(docs, "doc_id").select("score", (F.col("quality") == 1).alias("positive"))


def best_f1_threshold(spark, d):
    b = M.best_f1_threshold(_scored(spark, d))
    return _rounded(b, "threshold", "f1")


def roc_curve(spark, d):
    r = M.roc(_scored(spark, d))
    return _rounded(r, *r.columns)


def auroc(spark, d):
    return _rounded(M.auroc(_scored(spark, d)), "auroc")


def label_probabilities(spark, d):
    return M.label_probabilities(scores(spark, d)).select("label", "rank", F.round("probability", 6).alias("probability"))


def confidence_deciles(spark, d):
    return _rounded(M.confidence_deciles(scores(spark, d)), "probability")


def confidence_minmax(spark, d):
    return _rounded(M.confidence_minmax(scores(spark, d)), "least", "most")


def _rates(key):
    return lambda: TR.Rates(key)


def _key(n):
    return F.concat_ws("/", "lang", (F.col("n_chars") % n).cast("string"))


def _labelled(spark, d):
    """The labelled documents and their points; positions in the order of ids, modulo the number of folds, are the folds."""
    # folds are written and numbered: without the texts, which no model here reads
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs, _points(spark, d)


def xval_average(spark, d):
    """A model trained and tested on five folds; its measures, averaged."""
    docs, points = _labelled(spark, d)
    out = TR.cross_validate(_rates(_key(9)), docs, points, 5, assign=D.with_fold)
    return _rounded(out, "value")


def learning_curve(spark, d):
    """The same for portions of the training sets."""
    docs, points = _labelled(spark, d)
    curve = TR.learning_curve(_rates(_key(9)), docs, points, [0.25, 0.5, 1.0], 3, assign=D.with_fold)
    return curve.select("metric_type", "label", F.explode("points").alias("p")).select("metric_type", "label", "p.portion", F.round("p.value", 6).alias("value"))


def competition_winner(spark, d):
    """Two models against each other on two folds."""
    docs, points = _labelled(spark, d)
    return _rounded(TR.compete({"fine": _rates(_key(40)), "coarse": _rates(_key(3))}, docs, points, 2, assign=D.with_fold), "f1")


def _points(spark, d):
    l = table(spark, d, "labels")
    ann = F.array(F.struct(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("is_positive")), F.struct(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("is_positive")))
    return D.labelled_points_binary(l.select("doc_id", ann.alias("annotations")))


def labeled_points_binary(spark, d):
    return _points(spark, d)


def labeled_points_multiclass(spark, d):
    return D.labelled_points_multiclass(_points(spark, d)).select("doc_id", "label", "class_id")


def label_distribution(spark, d):
    return D.label_distribution(_points(spark, d).where("y = 1"))


def ensure_two_classes(spark, d):
    one = _points(spark, d).where("label = 'quality' and y = 1").select("doc_id", "y")
    return D.ensure_two_classes(one)


def union_all_balance(spark, d):
    p = _points(spark, d)
    return p.where("y = 1").unionByName(p.where("y = 0")).groupBy("label", "y").agg(F.count("*").alias("n"))


def portion_prefix(spark, d):
    return D.prefix_portion(table(spark, d, "documents").select("doc_id"), 0.3)


def validation_sample(spark, d):
    return D.validation_sample(table(spark, d, "documents").select("doc_id", "text"), 30).select("doc_id")


def kfold_split(spark, d):
    return D.with_fold(table(spark, d, "documents").select("doc_id"), 5)


def gang_summary(spark, d):
    """Multilabel sets of reduced scores over their thresholds against labels from arithmetic."""
    g = R.gang_reduce(scores(spark, d)).where("probability >= 0.5").groupBy("doc_id").agg(F.collect_set("label").alias("predicted"))
    docs = table(spark, d, "documents").select("doc_id", F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "alpha"), F.when(F.col("doc_id") % 3 == 0, "beta")), lambda x: x.isNotNull()).alias("gold"))
    m = M.multilabel(docs.join(g, "doc_id", "left").select("gold", F.coalesce("predicted", F.array().cast("array<string>")).alias("predicted")), 3)
    return _rounded(m, "hamming_loss", "micro_f1").select("hamming_loss", "micro_f1")


QUERIES = {f.__name__: f for f in (
    doc_rule_matches, doc_rule_score, valid_rules, rules_by_label, weighted_average, gang_reduce, gang_predict, forced_filter, argmax_label, threshold_filter, sort_predictions, model_validate, suggested_thresholds,
    has_overlaps, span_islands, span_union_avg, annotation_overlap, filter_annotations, bio_assemble, bio_parse, bio_tagging, gold_span_align, span_exact_match, span_prf, token_match_prf, token_tag_prf, eval_confusion, prf_by_label,
    micro_macro_prf, multiclass_metrics, multilabel_metrics, multilabel_by_label, best_f1_threshold, roc_curve, auroc, label_probabilities, confidence_deciles, confidence_minmax, xval_average, learning_curve, competition_winner,
    labeled_points_binary, labeled_points_multiclass, label_distribution, ensure_two_classes, union_all_balance, portion_prefix, validation_sample, kfold_split, gang_summary,
)}

_SAFE = lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"
_SCORE_RULES = f"""rs AS (SELECT doc_id, label, coalesce(sum(n) FILTER (WHERE weight = 1), 0) AS w, coalesce(sum(n) FILTER (WHERE weight = 0), 0) AS b, sum(n * weight) AS s, sum(n) AS t FROM matches GROUP BY doc_id, label),
    rule_scores AS (SELECT doc_id, label, CASE WHEN w + b > 0 THEN CAST(w AS DOUBLE) / (w + b) ELSE s / t END AS probability, CAST(CASE WHEN w + b > 0 THEN w + b ELSE t END AS BIGINT) AS match_count, CASE WHEN w + b > 0 THEN 3 ELSE 2 END AS flags FROM rs)"""


def _gang(src: str) -> str:
    return f"""f AS (SELECT *, max(flags & 1) OVER (PARTITION BY doc_id, label) AS any_forced FROM {src}), k AS (SELECT * FROM f WHERE any_forced = 0 OR (flags & 1) = 1),
    sides AS (SELECT doc_id, label, flags & 2 AS r, sum(match_count * probability) / sum(match_count) AS p, sum(match_count) AS n, bit_or(flags) AS fl FROM k GROUP BY ALL),
    gang AS (SELECT doc_id, label, CASE WHEN count(*) = 2 THEN CASE WHEN sum(p) > 0 THEN 2 * product(p) / sum(p) ELSE 0 END ELSE max(p) END AS probability, CAST(sum(n) AS BIGINT) AS match_count, bit_or(fl) AS flags FROM sides GROUP BY doc_id, label)"""


_PRF = lambda src, keys="label": f"SELECT {keys}, tp, fp, fn, round({_SAFE('tp', '(tp + fp)')}, 6) AS precision, round({_SAFE('tp', '(tp + fn)')}, 6) AS recall, round({_SAFE('2.0 * tp', '(2 * tp + fp + fn)')}, 6) AS f1 FROM {src}"
_GOLDP = f"{SPANS}, g AS (SELECT doc_id, label, \"offset\", length FROM spans WHERE l_partkey % 3 <> 0), p AS (SELECT doc_id, label, \"offset\", length FROM spans WHERE l_suppkey % 4 <> 0)"


def _span_counts(keys: str) -> str:
    return f"{_GOLDP}, gd AS (SELECT DISTINCT label, {keys}, 1 AS g FROM g), pd AS (SELECT DISTINCT label, {keys}, 1 AS p FROM p), j AS (SELECT * FROM gd FULL JOIN pd USING (label, {keys})), c AS (SELECT label, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM j GROUP BY label)"


_PAIRS = "pairs AS (SELECT lang AS gold, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END ELSE lang END AS predicted FROM documents), c AS (SELECT label, count(*) FILTER (WHERE gold = label AND predicted = label) AS tp, count(*) FILTER (WHERE gold <> label AND predicted = label) AS fp, count(*) FILTER (WHERE gold = label AND predicted <> label) AS fn FROM pairs, (SELECT gold AS label FROM pairs UNION SELECT predicted FROM pairs) GROUP BY label)"
_SCORED = "scored AS (SELECT (n_chars % 1000) / 1000.0::DOUBLE AS score, quality = 1 AS pos FROM labels JOIN documents USING (doc_id)), h AS (SELECT score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM scored GROUP BY score), cv AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM h WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
_TAGS = "tags AS (SELECT doc_id, pos, CASE WHEN starts_with(word, 'th') THEN 'BX' WHEN regexp_matches(word, '^[so]') THEN 'IX' ELSE 'O' END AS tag, (length(word) % 7) / 7.0::DOUBLE AS confidence, pos * 10 AS \"offset\", least(length(word), 9) AS length FROM toks)"
_TA = f"{TOKS}, t AS (SELECT doc_id, pos, pos * 10 AS o FROM toks), a AS (SELECT doc_id, 'P' AS label, 15 AS ao, 20 AS al FROM documents UNION ALL SELECT doc_id, 'Q', 60 + doc_id % 10, 25 FROM documents)"
_POINTS = "points AS (SELECT doc_id, 'quality' AS label, CAST(quality = 1 AS DOUBLE) AS y FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic = 1 AS DOUBLE) FROM labels)"
_MULTI = lambda src, n: f"SELECT round(avg({_SAFE('b', 'p')}), 6) AS precision, round(avg({_SAFE('b', 'g')}), 6) AS recall, round(avg({_SAFE('2 * b', '(g + p)')}), 6) AS f1, round(avg(CASE WHEN g + p - b > 0 THEN CAST(b AS DOUBLE) / (g + p - b) ELSE 1.0 END), 6) AS accuracy, round(avg(CASE WHEN b = g AND b = p THEN 1.0 ELSE 0.0 END), 6) AS subset_accuracy, round(avg((g + p - 2 * b) / {float(n)!r}), 6) AS hamming_loss, round({_SAFE('sum(b)', 'sum(p)')}, 6) AS micro_precision, round({_SAFE('sum(b)', 'sum(g)')}, 6) AS micro_recall, round({_SAFE('2 * sum(b)', '(sum(g) + sum(p))')}, 6) AS micro_f1 FROM {src}"
_LABELLED = " UNION ALL ".join(f"SELECT 'Label{m}' AS metric, label, round({e}, 6) AS value FROM pr" for m, e in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("FalsePositiveRate", "fpr")))
_WHOLE = " UNION ALL ".join(f"SELECT '{m}', NULL, round(sum({e}), 6) FROM pr" for m, e in (("Precision", "tp / tot"), ("Recall", "tp / tot"), ("F1", "tp / tot"), ("WeightedPrecision", "sup / tot * precision"), ("WeightedRecall", "sup / tot * recall"), ("WeightedF1", "sup / tot * f1"), ("WeightedFalsePositiveRate", "sup / tot * fpr")))


def _xval_sql(folds: int, portions: list[float], keys: list[tuple[str, int]]) -> str:
    """``av (name, portion, metric_type, label, value)``: rates by language and length, trained and tested on folds."""
    runs = ", ".join(f"('{n}', {m}, {p!r}::DOUBLE, {k})" for n, m in keys for p in portions for k in range(folds))
    per = lambda m, e: f"SELECT name, portion, k, '{m}' AS metric_type, label, {e} AS value FROM c WHERE tp + fp + fn > 0"
    whole = lambda m, e: f"SELECT name, portion, k, '{m}' AS metric_type, NULL AS label, {e} AS value FROM (SELECT name, portion, k, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS mf FROM (SELECT *, {_SAFE('2.0 * tp', '(2 * tp + fp + fn)')} AS f1 FROM c WHERE tp + fp + fn > 0) GROUP BY ALL)"
    return f"""{_POINTS}, dd AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    runs(name, m, portion, k) AS (VALUES {runs}),
    side AS (SELECT r.*, dd.doc_id, lang || '/' || (n_chars % m) AS key, place % {folds} = k AS test, row_number() OVER (PARTITION BY name, portion, k, place % {folds} = k ORDER BY dd.doc_id) AS nth, count(*) OVER (PARTITION BY name, portion, k, place % {folds} = k) AS n FROM runs r CROSS JOIN dd),
    tr AS (SELECT s.*, p.label, p.y FROM side s JOIN points p USING (doc_id) WHERE NOT test AND nth <= floor(n * portion)),
    own AS (SELECT name, portion, k, label, key, avg(y) AS rate FROM tr GROUP BY ALL), rest AS (SELECT name, portion, k, label, avg(y) AS rate FROM tr GROUP BY ALL),
    sc AS (SELECT s.name, s.portion, s.k, p.label, p.y = 1 AS g, coalesce(o.rate, r.rate) >= 0.5 AS p FROM side s JOIN points p USING (doc_id) JOIN rest r ON r.name = s.name AND r.portion = s.portion AND r.k = s.k AND r.label = p.label LEFT JOIN own o ON o.name = s.name AND o.portion = s.portion AND o.k = s.k AND o.label = p.label AND o.key = s.key WHERE test),
    c AS (SELECT name, portion, k, label, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM sc GROUP BY ALL),
    each AS ({per('LabelPrecision', _SAFE('tp', '(tp + fp)'))} UNION ALL {per('LabelRecall', _SAFE('tp', '(tp + fn)'))} UNION ALL {per('LabelF1', _SAFE('2.0 * tp', '(2 * tp + fp + fn)'))} UNION ALL {whole('F1', _SAFE('2.0 * tp', '(2 * tp + fp + fn)'))} UNION ALL {whole('MacroF1', 'mf')}),
    av AS (SELECT name, portion, metric_type, label, avg(value) AS value FROM each GROUP BY ALL)"""


_TWO = f"{_TA}, b AS (SELECT doc_id, label, ao + CASE WHEN label = 'P' THEN 12 ELSE 0 END AS ao, al FROM a WHERE label = 'P' OR doc_id % 2 = 0)"
_TAGGED = lambda src: f"(SELECT doc_id, pos, arg_min(CASE WHEN k = 1 THEN 'B' ELSE 'I' END || label, ao) AS tag FROM (SELECT t.doc_id, t.pos, x.label, x.ao, row_number() OVER (PARTITION BY t.doc_id, x.ao ORDER BY t.pos) AS k FROM t JOIN {src} x ON x.doc_id = t.doc_id AND t.o + 9 > x.ao AND t.o < x.ao + x.al) GROUP BY doc_id, pos)"
_TOKEN = lambda tag: f"{_TWO}, gd AS (SELECT doc_id, pos, {tag} AS label, 1 AS g FROM {_TAGGED('a')}), pd AS (SELECT doc_id, pos, {tag} AS label, 1 AS p FROM {_TAGGED('b')}), j AS (SELECT * FROM gd FULL JOIN pd USING (doc_id, pos, label)), c AS (SELECT label, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM j GROUP BY label)"

ORACLES = {
    "doc_rule_matches": f"WITH {MATCHES} SELECT doc_id, label, rule, weight, CAST(n AS INTEGER) AS n FROM matches",
    "doc_rule_score": f"WITH {MATCHES}, {_SCORE_RULES} SELECT doc_id, label, round(probability, 6) AS probability, match_count, flags FROM rule_scores",
    "valid_rules": "SELECT * FROM (VALUES " + ", ".join(f"('{l}', '{e}', {w!r}::DOUBLE)" for l, e, w, _ in _PATTERNS) + ") t(label, expression, weight)",
    "rules_by_label": "SELECT label, string_agg(expression, ' ' ORDER BY expression) AS expressions FROM (VALUES " + ", ".join(f"('{l}', '{e}')" for l, e, _ in RULES) + ") t(label, expression) GROUP BY label",
    "weighted_average": f"WITH {SCORES} SELECT doc_id, label, round(sum(match_count * probability) / sum(match_count), 6) AS probability FROM scores GROUP BY doc_id, label",
    "gang_reduce": f"WITH {SCORES}, {_gang('scores')} SELECT doc_id, label, round(probability, 6) AS probability, match_count, flags FROM gang",
    "gang_predict": f"WITH {SCORES}, {MATCHES}, {_SCORE_RULES}, both_ AS (SELECT doc_id, label, probability, match_count, flags FROM rule_scores UNION ALL SELECT doc_id, label, probability, match_count, flags FROM scores WHERE model <> 'rules'), {_gang('both_')} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(probability, 6) DESC, label) - 1 AS INTEGER) AS place, label, round(probability, 6) AS probability FROM gang",
    "forced_filter": f"WITH {SCORES}, f AS (SELECT *, max(flags & 1) OVER (PARTITION BY doc_id, label) AS m FROM scores) SELECT doc_id, label, model, flags FROM f WHERE m = 0 OR (flags & 1) = 1",
    "argmax_label": f"WITH {SCORES}, {_TH}, r AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY probability < coalesce(threshold, 0.5), probability DESC, s.label) AS k FROM scores s LEFT JOIN th USING (label) WHERE model = 'm1') SELECT doc_id, label, round(probability, 6) AS probability FROM r WHERE k = 1",
    "threshold_filter": f"WITH {SCORES}, {_TH} SELECT doc_id, model, label FROM scores LEFT JOIN th USING (label) WHERE probability >= coalesce(threshold, 0.5)",
    "sort_predictions": f"WITH {SCORES} SELECT doc_id, string_agg(label, ' ' ORDER BY probability DESC, label) AS labels FROM scores WHERE model = 'm2' GROUP BY doc_id",
    "model_validate": "SELECT doc_id, label FROM documents, (VALUES ('alpha'), ('beta'), ('gamma')) t(label) WHERE doc_id % 50 = 0",
    "suggested_thresholds": f"WITH {SCORES} SELECT label, CAST(max(match_count) AS DOUBLE) AS threshold FROM scores GROUP BY label",
    "has_overlaps": f"WITH {SPANS}, o AS (SELECT doc_id, coalesce(\"offset\" + length > lead(\"offset\") OVER (PARTITION BY doc_id ORDER BY \"offset\", length DESC), false) AS x FROM spans) SELECT doc_id, max(CAST(x AS INTEGER)) AS has_overlaps FROM o GROUP BY doc_id",
    "span_islands": f"WITH {SPANS}, m AS (SELECT *, max(\"offset\" + length) OVER (PARTITION BY doc_id ORDER BY \"offset\", length DESC, label, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR \"offset\" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY \"offset\", length DESC, label, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc_id, CAST(island AS BIGINT) AS island, min(\"offset\") AS start, max(\"offset\" + length) AS \"end\", count(*) AS n FROM i GROUP BY doc_id, island",
    "span_union_avg": f"WITH {SPANS}, m AS (SELECT *, max(\"offset\" + length) OVER (PARTITION BY doc_id ORDER BY \"offset\", length DESC, label, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR \"offset\" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY \"offset\", length DESC, label, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY doc_id ORDER BY \"offset\", length DESC, label, l_partkey, l_suppkey) AS k FROM m) SELECT doc_id, arg_min(label, k) AS label, round(avg(probability), 6) AS probability, bit_or(flags) AS flags, min(\"offset\") AS \"offset\", max(\"offset\" + length) - min(\"offset\") AS length FROM i GROUP BY doc_id, island",
    "annotation_overlap": f"WITH {SPANS} SELECT a.doc_id, a.\"offset\" AS ao, b.\"offset\" AS bo FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND b.\"offset\" + b.length > a.\"offset\" AND b.\"offset\" < a.\"offset\" + a.length WHERE a.label = 'A' AND b.label <> 'A' AND a.length > 0 AND b.length > 0",
    "filter_annotations": f"WITH {SPANS} SELECT label, count(*) AS n FROM spans WHERE length > 20 AND label <> '' GROUP BY label",
    "bio_assemble": f"WITH {TOKS}, {_TAGS}, r AS (SELECT *, CASE WHEN left(tag, 1) = 'I' AND left(lag(tag) OVER o, 1) IN ('B', 'I') THEN 0 ELSE 1 END AS new FROM tags WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), q AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT doc_id, 'X' AS label, CAST(min(\"offset\") AS INTEGER) AS start, CAST(max(\"offset\" + length) AS INTEGER) AS \"end\", count(*) AS n, round(avg(confidence), 6) AS probability FROM q GROUP BY doc_id, run HAVING arg_min(left(tag, 1), pos) = 'B'",
    "bio_parse": f"WITH {TOKS}, {_TAGS} SELECT left(tag, 1) AS kind, CASE WHEN tag <> 'O' THEN substr(tag, 2) END AS label, count(*) AS n FROM tags GROUP BY ALL",
    "bio_tagging": f"WITH {_TA}, h AS (SELECT t.doc_id, t.pos, a.label, a.ao, row_number() OVER (PARTITION BY t.doc_id, a.ao ORDER BY t.pos) AS k FROM t JOIN a ON a.doc_id = t.doc_id AND t.o + 9 > ao AND t.o < ao + al), x AS (SELECT t.doc_id, t.pos, coalesce(arg_min(CASE WHEN k = 1 THEN 'B' ELSE 'I' END || label, ao), 'O') AS tag FROM t LEFT JOIN h ON h.doc_id = t.doc_id AND h.pos = t.pos GROUP BY ALL) SELECT doc_id, tag, count(*) AS n, CAST(min(pos) AS INTEGER) AS first FROM x GROUP BY doc_id, tag",
    "gold_span_align": f"WITH {_TA} SELECT t.doc_id, label, CAST(min(o) AS INTEGER) AS \"offset\", CAST(sum(9) AS INTEGER) AS length FROM t JOIN a ON a.doc_id = t.doc_id AND t.o + 9 > ao AND t.o < ao + al GROUP BY t.doc_id, label, ao, al",
    "span_exact_match": f"WITH {_GOLDP} SELECT label, count(*) AS n FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.label = p.label AND g.\"offset\" = p.\"offset\" AND g.length = p.length) GROUP BY label",
    "span_prf": f"WITH {_span_counts('doc_id, \"offset\", length')} {_PRF('c')}",
    "token_match_prf": f"WITH {_TOKEN('substr(tag, 2)')} {_PRF('c')}",
    "token_tag_prf": f"WITH {_TOKEN('tag')} {_PRF('c')}",
    "multilabel_by_label": f"WITH x AS (SELECT 'quality' AS label, quality = 1 AS g, doc_id % 7 <> 0 AS p FROM labels UNION ALL SELECT 'toxic', toxic = 1, doc_id % 3 = 0 FROM labels), c AS (SELECT label, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM x GROUP BY label) {_PRF('c')}",
    "eval_confusion": f"WITH {_PAIRS} SELECT gold, predicted, count(*) AS n FROM pairs GROUP BY ALL",
    "prf_by_label": f"WITH {_PAIRS} {_PRF('c')}",
    "micro_macro_prf": f"WITH {_PAIRS}, p AS (SELECT tp, fp, fn, {_SAFE('tp', '(tp + fp)')} AS a, {_SAFE('tp', '(tp + fn)')} AS b, {_SAFE('2.0 * tp', '(2 * tp + fp + fn)')} AS f FROM c), s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(a) AS ma, avg(b) AS mb, avg(f) AS mf FROM p) SELECT round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, round(ma, 6) AS macro_precision, round(mb, 6) AS macro_recall, round(mf, 6) AS macro_f1 FROM s",
    "multiclass_metrics": f"WITH {_PAIRS}, pr AS (SELECT label, CAST(tp AS DOUBLE) AS tp, CAST(tp + fn AS DOUBLE) AS sup, CAST(sum(tp + fn) OVER () AS DOUBLE) AS tot, {_SAFE('tp', '(tp + fp)')} AS precision, {_SAFE('tp', '(tp + fn)')} AS recall, {_SAFE('2.0 * tp', '(2 * tp + fp + fn)')} AS f1, CAST(fp AS DOUBLE) / (sum(tp + fn) OVER () - tp - fn) AS fpr FROM c) {_LABELLED} UNION ALL {_WHOLE}",
    "multilabel_metrics": f"WITH x AS (SELECT CAST(quality = 1 AS INTEGER) + CAST(toxic = 1 AS INTEGER) AS g, CAST(doc_id % 7 <> 0 AS INTEGER) + CAST(doc_id % 3 = 0 AS INTEGER) AS p, CAST(quality = 1 AND doc_id % 7 <> 0 AS INTEGER) + CAST(toxic = 1 AND doc_id % 3 = 0 AS INTEGER) AS b FROM labels) {_MULTI('x', 2)}",
    "best_f1_threshold": f"WITH {_SCORED}, f AS (SELECT score, {_SAFE('2 * tp', '(tp + fp + pos)')} AS f1 FROM cv) SELECT round(score, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score DESC LIMIT 1",
    "roc_curve": f"WITH {_SCORED} SELECT round(score, 6) AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (tp + fp + pos), 6) AS f1 FROM cv",
    "auroc": f"WITH {_SCORED}, a AS (SELECT (fp - coalesce(lag(fp) OVER w, 0)) * (tp + coalesce(lag(tp) OVER w, 0)) / 2.0::DOUBLE AS a, pos, neg FROM cv WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(a) / (max(pos) * max(neg)), 6) AS auroc FROM a",
    "label_probabilities": f"WITH {SCORES} SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY probability) - 1 AS INTEGER) AS rank, round(probability, 6) AS probability FROM scores",
    "confidence_deciles": f"WITH {SCORES}, r AS (SELECT label, probability, row_number() OVER (PARTITION BY label ORDER BY probability) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM scores) SELECT label, CAST(i AS INTEGER) AS decile, round(probability, 6) AS probability FROM r, (SELECT unnest(range(1, 10)) AS i) WHERE k = greatest(n // 10 - 1, 0) + (i - 1) * (n // 10) + (i * (n % 10)) // 10",
    "confidence_minmax": f"WITH {SCORES} SELECT label, round(min(probability), 6) AS least, round(max(probability), 6) AS most FROM scores GROUP BY label",
    "xval_average": f"WITH {_xval_sql(5, [1.0], [('a', 9)])} SELECT metric_type, 'Model' AS metric_class, label, 0.0::DOUBLE AS x, round(value, 6) AS value FROM av",
    "learning_curve": f"WITH {_xval_sql(3, [0.25, 0.5, 1.0], [('a', 9)])} SELECT metric_type, label, portion, round(value, 6) AS value FROM av WHERE metric_type <> 'MacroF1'",
    "competition_winner": f"WITH {_xval_sql(2, [1.0], [('fine', 40), ('coarse', 3)])} SELECT name, round(value, 6) AS f1 FROM av WHERE metric_type = 'F1' ORDER BY value DESC, name LIMIT 1",
    "labeled_points_binary": f"WITH {_POINTS} SELECT * FROM points",
    "labeled_points_multiclass": f"WITH {_POINTS}, f AS (SELECT label, min(doc_id) AS m FROM points WHERE y = 1 GROUP BY label), i AS (SELECT label, row_number() OVER (ORDER BY m, label) - 1 AS k FROM f) SELECT doc_id, label, CAST(k AS INTEGER) AS class_id FROM points JOIN i USING (label) WHERE y = 1",
    "label_distribution": f"WITH {_POINTS} SELECT label, count(*) AS n FROM points WHERE y = 1 GROUP BY label",
    "ensure_two_classes": "SELECT doc_id, y::DOUBLE AS y FROM labels, (VALUES (0), (1)) t(y) WHERE quality = 1",
    "union_all_balance": f"WITH {_POINTS} SELECT label, y, count(*) AS n FROM points GROUP BY ALL",
    "portion_prefix": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k <= floor(n * 0.3)",
    "validation_sample": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text ORDER BY 1 LIMIT 30",
    "kfold_split": "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents",
    "gang_summary": f"WITH {SCORES}, {_gang('scores')}, s AS (SELECT d.doc_id, t.label, (t.label = 'alpha' AND d.doc_id % 2 = 0) OR (t.label = 'beta' AND d.doc_id % 3 = 0) AS g, coalesce(k.probability >= 0.5, false) AS p FROM documents d CROSS JOIN (VALUES ('alpha'), ('beta'), ('gamma')) t(label) LEFT JOIN gang k ON k.doc_id = d.doc_id AND k.label = t.label), x AS (SELECT doc_id, sum(CAST(g AS INTEGER)) AS g, sum(CAST(p AS INTEGER)) AS p, sum(CAST(g AND p AS INTEGER)) AS b FROM s GROUP BY doc_id) SELECT hamming_loss, micro_f1 FROM ({_MULTI('x', 3)})",
}
