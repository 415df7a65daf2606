"""Tables written for a query's own use, in the folder that all executors share; and their removal."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where unset one of our own, which only a local master can do with."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        where = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Tables written and not yet removed.
_WRITTEN: dict[str, object] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used, removed like a table."""
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_at_end)
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: no recomputation, no lineage.

    Results are lazy, so a written table has to outlive the call. It is removed by ``discard``, by ``clean``, or when the driver ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.pop(path, None)


def _at_end() -> None:
    """Remove what is left if the context still runs; a driver that has stopped it leaves the tables to the folder's own expiry."""
    with contextlib.suppress(Exception):  # the JVM may be gone
        for path, spark in list(_WRITTEN.items()):
            _remove(spark, path)


def _paths(df: DataFrame) -> list[str]:
    return [w for w in _WRITTEN if any(w in f for f in df.inputFiles()[:1])]


def discard(df: DataFrame) -> None:
    """Remove the written table behind ``df``, which nothing reads any more."""
    for path in _paths(df):
        _remove(df.sparkSession, path)


def written() -> set[str]:
    """The tables there are, to tell ``forget`` what came later."""
    return set(_WRITTEN)


def forget(since: set[str], *keep: DataFrame) -> None:
    """Remove the tables written since, but for those behind ``keep``: intermediate ones, once what they were for is written itself."""
    for path in set(_WRITTEN) - since - {p for df in keep for p in _paths(df)}:
        _remove(_WRITTEN[path], path)


def clean(spark: SparkSession) -> None:
    """Remove all tables that this driver has written to the shared folder; results that read them can't be read after."""
    for path in list(_WRITTEN):
        _remove(spark, path)


#: A table of fewer bytes that lies in fewer files than there are cores is dealt out to all of them before costly work.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a small table's few files would leave most of them idle: what a file of one row group holds is one task's.

    Larger tables, and those of many files, stay as they are: nothing is shuffled for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < SPREAD_BYTES else df
