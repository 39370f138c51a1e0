"""Helpers that every training-data operator uses: table access, shared storage, document keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Arrow batches end at this many bytes, so that a few very long texts cannot fill a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory, read by Spark so that any of its file systems serves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; a bound that the session already has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under a temporary folder, which only a driver whose
    executors run in its own process can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="assaykit-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/assaykit-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._assaykit_path = path
    return out


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` such that ``_metadata`` tells the file and place of each row: written first, unless it is read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return materialize(docs, "documents")
    return docs


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later step reads."""
    for df in frames:
        if path := getattr(df, "_assaykit_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def release(spark: SparkSession) -> None:
    """Have the driver forget finished plans now, so that executors delete their shuffle files before the next step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_worker: dict[tuple, object] = {}


def worker_cache(key: tuple, make):
    """What a Python worker keeps between its tasks, for one operator at a time: asking for another drops it."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def drop_worker_cache() -> None:
    """For operators that need the worker's memory themselves."""
    _worker.clear()
