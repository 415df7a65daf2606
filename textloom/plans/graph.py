"""Feature graphs: a configuration of named transforms becomes columns of one DataFrame plan.

``{"transforms": [{"name", "class", "config"}], "pipeline": [{"name", "inputs"}]}``. Inputs are transform names or
``$document``; the entry ``$output`` names the results. The graph is checked whole before any plan is made.
"""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import language as L
from ..functions import stopwords as S
from ..functions import tokenizer as T
from ..operators import indexing
from ..scratch import materialize
from ..sources import io

#: class: (builder from configuration to a function of input columns, input types, output type)
REGISTRY: dict[str, tuple[Callable, tuple[str, ...], str]] = {}


def register_transform(name: str, inputs: tuple[str, ...], output: str):
    """A user's transform: a function from its configuration to a function of columns. ``"T*"`` takes any number."""

    def add(builder):
        REGISTRY[name] = (builder, inputs, output)
        return builder

    return add


@register_transform("ContentExtractor", ("document",), "string")
def _content(config):
    return lambda d: d["content"]


@register_transform("ContentTypeDetector", ("document",), "contentType")
def _content_type(config):
    deep = config.get("deepDetection", False)

    def run(d):
        feed = d["metadata"]["lexisnexis"].isNotNull() | d["metadata"]["newscred"].isNotNull()
        plain = C.content_type(d["content"], F.coalesce(feed, F.lit(False)))
        return F.when(plain != "PlainText", plain).otherwise(T.sniff_column(d["content"])) if deep else plain

    return run


@register_transform("LanguageDetector", ("document", "contentType"), "language")
def _language(config):
    """The declared language if it resolves, else the detected one; ``profiles`` takes the place of the package's own."""
    profiles = L.compile_profiles(config["profiles"] if "profiles" in config else L.default_profiles())

    def run(d, t):
        declared = C.normalize_language(d["metadata"]["iso_639_1"]) if "metadata" in d else F.lit(None).cast("string")
        # documents that declare their language aren't looked at
        text = F.when(declared.isNull(), d["content"])
        return F.coalesce(declared, L.detect_first(text, t.isin("HTML", "XML"), profiles))

    return run


@register_transform("TokenTransformer", ("string", "language", "contentType"), "tokens")
def _tokens(config):
    return lambda s, lang, t: T.tokens(s, t)


@register_transform("BagOfWords", ("tokens", "language"), "strings")
def _bow(config):
    return lambda t, lang: C.bag_of_words(t, config.get("accept", ["Word"]), config.get("transform", "ToLower"), lang)


@register_transform("WordShapes", ("tokens",), "strings")
def _shapes(config):
    return lambda t: F.transform(t, lambda x: C.word_shape(x["content"]))


@register_transform("Stopwords", ("strings", "language"), "strings")
def _stop(config):
    """Lists given under ``languages`` take the place of the package's; ``defaultStopwordLanguage`` serves languages without one."""
    lists = S.stopword_map({k: set(v) for k, v in config.get("languages", {}).items()}, None if config.get("builtIn", True) else {})
    default = config.get("defaultStopwordLanguage")
    return lambda w, lang: C.drop_stopwords(w, S.stopword_column(lists, lang, default)) if lists else w


@register_transform("Ngrams", ("strings",), "strings")
def _ngrams(config):
    return lambda w: F.transform(C.ngrams(w, config.get("min", 1), config.get("max", 3)), C.display)


@register_transform("Skipgrams", ("strings",), "strings")
def _skipgrams(config):
    return lambda w: F.transform(C.skipgrams(w, config.get("k", 2), config.get("n", 2)), C.display)


@register_transform("Lift", ("string*",), "strings")
def _lift(config):
    return lambda *c: C.lift(*c)


class Terminal:
    """A transform that ends in a vector: it has a ``dimension``, can be pruned to the dims in use, and turns dims back into features.

    ``fit`` sees rows ``(doc_id, pos, feature)``; ``vectors`` makes ``(doc_id, dim, value)`` of such rows.
    """

    def __init__(self, config: dict):
        self.config = config

    def fit(self, feats: DataFrame) -> None:
        raise NotImplementedError

    def vectors(self, feats: DataFrame) -> DataFrame:
        raise NotImplementedError

    @property
    def dimension(self) -> int:
        raise NotImplementedError

    def prune(self, used: DataFrame) -> None:
        """``used``: a column ``dim``; the others have no feature any more, ids and dimension stay."""

    def invert(self, dims: DataFrame) -> DataFrame:
        """``dims`` (a column ``dim``) with ``feature``, null where there is none."""
        return dims.withColumn("feature", F.lit(None).cast("string"))


#: class: (terminal, input type)
TERMINALS: dict[str, tuple[type[Terminal], str]] = {}


def register_terminal(name: str, input_type: str = "strings"):
    """A user's terminal, a subclass of ``Terminal``."""

    def add(cls):
        TERMINALS[name] = (cls, input_type)
        return cls

    return add


@register_terminal("IndexTransformer")
class IndexTerminal(Terminal):
    """Counts of the features of a vocabulary, those seen ``minimumObservations`` times."""

    vocabulary: DataFrame | None = None
    size = 0

    def fit(self, feats):
        self.vocabulary = materialize(indexing.build_vocabulary(feats, self.config.get("minimumObservations", 0)), "vocabulary")
        self.size = self.vocabulary.count()

    def _counts(self, feats):
        if self.vocabulary is None:
            raise ValueError("the graph isn't primed")
        return indexing.term_counts(feats, self.vocabulary, self.size)

    def vectors(self, feats):
        return self._counts(feats).select("doc_id", "dim", F.col("tf").cast("double").alias("value"))

    @property
    def dimension(self):
        return self.size

    def prune(self, used):
        self.vocabulary = materialize(indexing.prune(self.vocabulary, used), "vocabulary")

    def invert(self, dims):
        return indexing.invert(dims, self.vocabulary)


@register_terminal("TfIdfTransformer")
class TfIdfTerminal(IndexTerminal):
    """Counts weighed by inverse document frequency; features of under ``minimumDocumentObservations`` documents weigh 0."""

    table: DataFrame | None = None

    def fit(self, feats):
        super().fit(feats)
        n_docs = feats.agg(F.countDistinct("doc_id").alias("n"))
        self.table = materialize(indexing.idf(indexing.document_frequencies(self._counts(feats)), n_docs, self.config.get("minimumDocumentObservations", 0)), "idf")

    def vectors(self, feats):
        return indexing.tfidf(self._counts(feats), self.table).where("value <> 0")


@register_terminal("Word2VecTransformer")
class Word2VecTerminal(Terminal):
    """Sums of the known words' vectors; ``vectors`` is ``(feature, embedding)`` or a path, of ``type`` ``bin`` or ``spark``."""

    def fit(self, feats):
        given = self.config["vectors"]
        if isinstance(given, str):
            read = io.read_word_vectors if self.config.get("type", "bin") == "bin" else io.read_word2vec_model
            given = read(feats.sparkSession, given).select(F.col("word").alias("feature"), F.col("vector").alias("embedding"))
        self.embeddings = given
        self.size = given.select(F.size("embedding").alias("n")).first().n

    def vectors(self, feats):
        return indexing.embedding_sums(feats, self.embeddings, ["doc_id"]).select("doc_id", F.col("i").alias("dim"), "value")

    @property
    def dimension(self):
        return self.size


class TransformGraph:
    """A checked graph: ``stages`` are lists of transforms that need only those before them."""

    def __init__(self, config: dict):
        if config.get("version", "0.0.1") != "0.0.1":
            raise ValueError(f"unknown version {config['version']}")
        self.transforms = {}
        for t in config["transforms"]:
            if t["name"].startswith("$"):
                raise ValueError(f"{t['name']}: names with $ are reserved")
            if t["class"] not in REGISTRY and t["class"] not in TERMINALS:
                raise ValueError(f"{t['name']}: no transform {t['class']}")
            self.transforms[t["name"]] = t
        self.inputs = {p["name"]: list(p["inputs"]) for p in config["pipeline"]}
        if "$output" not in self.inputs:
            raise ValueError("the pipeline has no $output")
        for name, inputs in self.inputs.items():
            if name != "$output" and name not in self.transforms:
                raise ValueError(f"{name} isn't among the transforms")
            for i in inputs:
                if i != "$document" and i not in self.inputs:
                    raise ValueError(f"{name}: unknown input {i}")
            if name != "$output":
                self._check_types(name, inputs)
        try:
            sorter = TopologicalSorter({n: [i for i in v if i != "$document"] for n, v in self.inputs.items()})
            sorter.prepare()
        except CycleError as e:
            raise ValueError(f"the pipeline has a cycle: {e.args[1]}") from None
        self.stages = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            self.stages.append([n for n in ready if n != "$output"])
            sorter.done(*ready)
        self.stages = [s for s in self.stages if s]
        self.outputs = self.inputs["$output"]
        ends = {n for n in self.inputs if n != "$output" and self.transforms[n]["class"] in TERMINALS}
        if used := sorted(i for n, v in self.inputs.items() if n != "$output" for i in v if i in ends):
            raise ValueError(f"{used} end in vectors, nothing can follow but $output")
        self.terminals = {n: TERMINALS[self.transforms[n]["class"]][0](self.transforms[n].get("config", {})) for n in self.outputs if n in ends}

    def _type(self, name: str) -> str:
        if name == "$document":
            return "document"
        kind = self.transforms[name]["class"]
        return "vector" if kind in TERMINALS else REGISTRY[kind][2]

    def _check_types(self, name: str, inputs: list[str]) -> None:
        kind = self.transforms[name]["class"]
        wanted = (TERMINALS[kind][1],) if kind in TERMINALS else REGISTRY[kind][1]
        if wanted and wanted[-1].endswith("*"):
            wanted = wanted[:-1] + (wanted[-1][:-1],) * (len(inputs) - len(wanted) + 1)
        found = tuple(self._type(i) for i in inputs)
        if found != wanted:
            raise ValueError(f"{name} takes {wanted}, not {found}")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with ``content`` and ``metadata``) and a column for each of ``$output``'s inputs.

        Each stage is one projection; only columns that are still needed live on, the rest Catalyst prunes.
        """
        out, prefix = docs, "__"
        document = {c: F.col(c) for c in docs.columns}
        for stage in self.stages:
            made: dict[str, Column] = {}
            for name in stage:
                t = self.transforms[name]
                if t["class"] in TERMINALS:
                    made[prefix + name] = F.col(prefix + self.inputs[name][0])
                    continue
                f = REGISTRY[t["class"]][0](t.get("config", {}))
                made[prefix + name] = f(*[document if i == "$document" else F.col(prefix + i) for i in self.inputs[name]])
            out = out.withColumns(made)
        return out.select(*docs.columns, *[F.col(prefix + i).alias(i) for i in self.inputs["$output"]])

    def _features(self, docs: DataFrame, name: str, id_col: str) -> DataFrame:
        return indexing.features(self.apply(docs), name, id_col)

    def _all_terminals(self) -> dict[str, Terminal]:
        if set(self.terminals) != set(self.outputs):
            raise ValueError("only terminals make vectors")
        return self.terminals

    def prime(self, docs: DataFrame, id_col: str = "doc_id") -> "TransformGraph":
        """Fit the terminals on the documents."""
        for name, t in self._all_terminals().items():
            t.fit(self._features(docs, name, id_col))
        return self

    def vectors(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """``(doc_id, dim, value)``: the terminals' vectors side by side, in the order of ``$output``."""
        return indexing.concatenate([(t.vectors(self._features(docs, name, id_col)), t.dimension) for name, t in self._all_terminals().items()])

    @property
    def dimension(self) -> int:
        return sum(t.dimension for t in self._all_terminals().values())

    def _split(self, dims: DataFrame):
        offset = 0
        for t in self._all_terminals().values():
            mine = dims.where((F.col("dim") >= offset) & (F.col("dim") < offset + t.dimension)).select((F.col("dim") - offset).cast("int").alias("dim"))
            yield t, mine, offset
            offset += t.dimension

    def prune(self, used: DataFrame) -> None:
        """Features whose ``dim`` isn't used go from the terminals; dims stay what they are."""
        for t, mine, _ in list(self._split(used)):
            t.prune(mine)

    def invert(self, dims: DataFrame) -> DataFrame:
        """``(dim, feature)``, null where a terminal has no feature for the dim."""
        parts = [t.invert(mine).select((F.col("dim") + offset).alias("dim"), "feature") for t, mine, offset in self._split(dims)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
