"""Helpers that all operators share: tables in the cluster's folder, shipping this package, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.scale import ensure_checkpoint_dir

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BATCH_ROWS = 2_000
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by `spark.checkpoint.dir`; a folder in /tmp only for a local master without one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: the plan so far runs once and its result outlives
    executors. The files stay until the folder is cleaned, as those of `checkpoint()` do."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this plan are of no use once its rows are written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by `stored` that no later step reads."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the sources of this package to the executors, once per Spark context."""
    if spark.conf.get(ROWS, "10000") == "10000":  # not set by the user: texts are long rows
        spark.conf.set(ROWS, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_tesserae_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "tesserae.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._tesserae_shipped = True


def give_back() -> None:
    """Return memory that this process holds but doesn't use: workers outlive their tasks, and a later one needs it elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_partitions(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`mapInArrow` with this package at hand; when a task ends, its worker keeps no memory that it doesn't need."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver forget plans of the past: Spark drops broadcasts and shuffle files on the executors only then, which may take
    long in a driver that has memory left. Takes about a second, so it is for the ends of long steps."""
    spark.sparkContext._jvm.System.gc()
    give_back()


_sent: list[Broadcast] | None = None


def broadcast(spark: SparkSession, value) -> Broadcast:
    """A broadcast variable; one made in a stage (see `new_stage`) goes when the next stage begins."""
    made = spark.sparkContext.broadcast(value)
    if _sent is not None:
        _sent.append(made)
    return made


def shrink_executors(spark: SparkSession) -> None:
    """Let the executors collect their garbage and return what is free then: a heap that grew in one step otherwise stays as large
    beside the Python workers of the next. One short task for each core, so that each executor gets one or more; takes about a second."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def new_stage(spark: SparkSession) -> None:
    """Begin a step whose input is written: broadcast variables of the step before are destroyed, as nothing reads them again, and
    driver and executors give back memory."""
    global _sent
    for made in _sent or []:
        made.destroy()
    _sent = []
    shrink_executors(spark)
    give_back()


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """`mapInArrow` for a function of one batch that gives any number of batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                if part.num_rows:
                    yield from function(part)

    return map_partitions(df, run, schema)


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns of the caller can't clash."""
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def filter_rows(docs: DataFrame, keep: Callable[[pa.Array], Iterable[bool]]) -> DataFrame:
    """The rows of `docs`, with all their columns, for whose texts `keep` holds. It gets the texts of a batch."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = keep(batch.column(batch.schema.get_field_index("text")).cast(pa.string()))
        yield batch.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)
