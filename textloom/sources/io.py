"""Readers and writers: NDJSON documents, text partitions, stop words, binary word vectors, CSV reports, landed points."""

from __future__ import annotations

import contextlib
import decimal
import enum
import fractions
import gzip
import json
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import sha1_name

ANNOTATION = "struct<label: string, is_positive: boolean, offset: int, length: int>"
DOCUMENT = "name string, content string, metadata map<string, string>, annotations array<struct<label: struct<name: string>, isPositive: boolean, offset: int, length: int>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON documents ``(name, content, metadata, annotations)``; a line that is no JSON gives nulls."""
    raw = spark.read.schema(DOCUMENT).json(path)
    flat = F.transform("annotations", lambda a: F.struct(a["label"]["name"].alias("label"), a["isPositive"].alias("is_positive"), a["offset"].alias("offset"), a["length"].alias("length")))
    return raw.withColumn("annotations", flat)


def read_text_documents(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The same from lines of text, spread over at least ``partitions``."""
    lines = spark.read.text(path)
    if partitions:
        lines = lines.repartition(partitions)
    return lines.select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")


def read_stopwords(spark: SparkSession, uri: str, language: str) -> DataFrame:
    """``(lang, word)`` of a file of one word a line, as it stands."""
    if urlparse(uri).scheme not in ("file", ""):
        raise ValueError(f"stop words come from file: addresses, not {uri}")
    return spark.read.text(uri).select(F.lit(language).alias("lang"), F.col("value").alias("word"))


def parse_word_vectors(raw: bytes) -> list[tuple[str, list[float]]]:
    """``count size`` in ASCII, then ``word SPACE float32 * size`` each, little-endian; a broken end ends the list."""
    head, _, rest = raw.partition(b"\n")
    count, size = map(int, head.split())
    out, at = [], 0
    for _ in range(count):
        space = rest.find(b" ", at)
        if space < 0 or space + 1 + 4 * size > len(rest):
            break
        word = rest[at:space].lstrip(b"\n").decode("utf-8", "replace")
        out.append((word, np.frombuffer(rest, "<f4", size, space + 1).tolist()))
        at = space + 1 + 4 * size
    return out


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector)`` of word vector files, gzip or plain, wherever Spark can read: a task a file. A broken end ends its file's list."""
    schema = pa.schema([("word", pa.string()), ("vector", pa.list_(pa.float32()))])

    def parse(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = parse_word_vectors(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                for i in range(0, len(rows), 10_000):
                    some = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some]), pa.array([v for _, v in some], pa.list_(pa.float32()))], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path.split(",") if "," in path else path)
    return files.select("content").mapInArrow(parse, "word string, vector array<float>")


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """``(word, vector)`` as gzip word vector files under ``path``, one a partition."""
    name = f"{path.rstrip('/')}/part-{{}}.bin.gz"

    def write(batches):
        words, vecs = [], []
        for b in batches:
            words += b.column(0).to_pylist()
            vecs += [np.asarray(v, "<f4") for v in b.column(1).to_pylist()]
        if words:
            body = f"{len(words)} {len(vecs[0])}\n".encode() + b"".join(w.encode() + b" " + v.tobytes() for w, v in zip(words, vecs))
            where, at = fs.FileSystem.from_uri(name.format(uuid.uuid4().hex)) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:").format(uuid.uuid4().hex))
            where.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with where.open_output_stream(at, compression=None) as f:
                f.write(gzip.compress(body, 1))
        yield pa.RecordBatch.from_arrays([pa.array([len(words)], pa.int64())], ["n"])

    vectors.select("word", "vector").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_word2vec_model(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector)`` of a word2vec model that Spark has saved: its table of words, or the weights and the index of older ones."""
    data = spark.read.parquet(f"{path}/data")
    if "word" in data.columns:
        return data.select("word", F.col("vector").cast("array<float>").alias("vector"))
    from pyspark.ml.feature import Word2VecModel
    from pyspark.ml.functions import vector_to_array

    return Word2VecModel.load(path).getVectors().select("word", vector_to_array("vector").cast("array<float>").alias("vector"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A whole file of one JSON object, wherever Spark can read."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is {len(rows)} files")
    value = json.loads(rows[0].value)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no object")
    return value


def to_json_value(value):
    """A host object as a JSON value: keys have to be strings, whole numbers stay whole, other numbers are doubles, anything else is an error."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, enum.Enum):
        return value.name
    if isinstance(value, dict):
        if bad := [k for k in value if not isinstance(k, str)]:
            raise TypeError(f"keys are strings, not {bad[0]!r}")
        return {k: to_json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json_value(v) for v in value]
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating, decimal.Decimal, fractions.Fraction)):
        return float(value)
    raise TypeError(f"no JSON value for {type(value).__name__}")


def documents_from(spark: SparkSession, objects: list[dict]) -> DataFrame:
    """Documents like those of ``read_documents`` from host objects."""
    lines = [(json.dumps(to_json_value(o)),) for o in objects]
    return spark.createDataFrame(lines, "value string").select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")


@contextlib.contextmanager
def replay(df: DataFrame, loops: int):
    """``loops`` times the same rows, to measure what is done with them: read once, kept by the executors while in use, and let go."""
    kept = df.persist() if loops > 1 else df
    try:
        yield (kept for _ in range(loops))
    finally:
        if loops > 1:
            kept.unpersist()


def wide_predictions(docs: DataFrame, predictions: DataFrame, labels: list[str], features: bool = False, id_col: str = "doc_id") -> DataFrame:
    """``(Name, Content, label ...)``, labels by name, 0.0 where a label is missing; with ``features`` each label's significant features."""
    labels = sorted(labels)
    aggs = [F.max(F.when(F.col("label") == l, F.col("probability"))).alias(l) for l in labels]
    if features:
        aggs += [F.max(F.when(F.col("label") == l, F.array_join("features", " "))).alias(f"features[{l}]") for l in labels]
    wide = predictions.groupBy(id_col).agg(*aggs)
    out = docs.select(id_col, F.col("name").alias("Name"), F.col("content").alias("Content")).join(wide, id_col, "left")
    return out.select("Name", "Content", *[F.coalesce(F.col(f"`{l}`"), F.lit(0.0)).alias(l) for l in labels], *([F.coalesce(F.col(f"`features[{l}]`"), F.lit("")).alias(f"features[{l}]") for l in labels] if features else []))


def span_report(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(Name, Span, Label, Confidence, Offset, Length)``."""
    j = docs.select(id_col, "name", "content").join(spans, id_col)
    return j.select(F.col("name").alias("Name"), F.substring("content", F.col("offset") + 1, F.col("length")).alias("Span"), F.col("label").alias("Label"), F.col("probability").alias("Confidence"), F.col("offset").alias("Offset"), F.col("length").alias("Length"))


def top_report(docs: DataFrame, best: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, F.col("name").alias("Name")).join(best, id_col).select("Name", F.col("label").alias("Label"), F.col("probability").alias("Probability"))


def insights_report(counts: DataFrame) -> DataFrame:
    """``(NGram, Count, Value)``: long grams first, then by falling count, then by value."""
    return counts.orderBy(F.desc("n"), F.desc("cnt"), "ngram").select(F.col("n").alias("NGram"), F.col("cnt").alias("Count"), F.col("ngram").alias("Value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` has written, with line ends, quotes and zeros inside of texts: a task a file. An empty text is null."""
    kept = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "multiLine": True, "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.options(**kept).schema(schema).csv(path)


def land_points(points: DataFrame, path: str, model: Column | None = None) -> None:
    """Append points as Parquet, a folder each model, named by the model id's hash."""
    named = points.withColumn("model_key", sha1_name(F.col("model_id") if model is None else model))
    named.write.mode("append").partitionBy("model_key").parquet(path)
