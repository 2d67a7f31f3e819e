"""A running aggregate as a table on disk that survives restarts.

Each micro-batch writes the keys whose values changed into a folder of its own, named by the batch. A batch that is repeated after a
failure replaces its folder, so nothing is counted twice; the state itself comes back from the checkpoint. The current value
of a key is the one of its latest batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.sources.files import exists, hadoop_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# state on the executors' disks instead of their heaps
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _set(spark: SparkSession, **settings: str | None) -> Iterator[None]:
    """Settings that a query takes when it starts; the session has its own back afterwards."""
    names = {"store": STATE_STORE, "partitions": "spark.sql.shuffle.partitions"}
    before = {names[k]: spark.conf.get(names[k], None) for k, v in settings.items() if v is not None}
    try:
        for key, value in settings.items():
            if value is not None:
                spark.conf.set(names[key], value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Rows of the Parquet files of a folder, also of those that appear later."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def keep_current(counts: DataFrame, path: str, checkpoint: str, *, interval: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Start to keep a running aggregate in `path`. Without an `interval`, the query ends when it has read what is there.

    Start it again with the same `checkpoint` to go on: state, position in the source and numbers of batches come from there.
    `partitions` is the number of state partitions, fixed by the first start.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    spark = counts.sparkSession
    with _set(spark, store=ROCKSDB, partitions=None if partitions is None else str(partitions)):
        writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return writer.foreachBatch(write).trigger(**trigger).start()


def current(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The current row of each key in a table that `keep_current` fills."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).parquet(f"{path}/batch=*")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long")
    values = [c for c in log.columns if c not in keys]
    latest = log.withColumn("__batch", number).groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("__row"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in log.columns])


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches in a table that `keep_current` fills."""
    if not exists(spark, path):
        return []
    filesystem, target = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in filesystem.listStatus(target)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
