"""Structured Streaming sources, late-data policy and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.operators.window import latest_per_key
from shirabe.session import scratch_path
from shirabe.streaming.tables import finished, remove_before

# State on the executors' disks, with only changes uploaded to the checkpoint: it may outgrow the heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk; the session's own settings come back afterwards.

    A query takes the provider when it first starts and keeps it in its checkpoint.
    """
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a landing folder (or a single file) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(location) and fs.getFileStatus(location).isFile():
        # A stream watches folders: watch the parent for this one name.
        folder, name = location.getParent().toString(), location.getName()
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def with_late_policy(df: DataFrame, ts: str, delay: str, unique: str | None = None) -> DataFrame:
    """Event-time watermark, and duplicates of ``unique`` dropped within it.

    The time column becomes a zoned timestamp: watermarks refuse zone-less ones.
    """
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark([unique]) if unique else timed


def feed(
    df: DataFrame, sink: str, checkpoint: str, *, every: str | None = None, mode: str = "append", partition_by: list[str] = ()
):
    """Write a stream as Parquet, every interval or (without one) for what is there now."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with state_on_disk(df.sparkSession):
        return writer.trigger(**trigger).start(sink)


def feed_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None, mode: str = "append"):
    """Hand each micro-batch to ``handle``; it must be safe to repeat for the same batch id."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    with state_on_disk(df.sparkSession):
        return writer.trigger(**trigger).start()


def drain(df: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what its sink holds.

    In append mode windows still open at the end are not in the sink.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "drain")
    feed(df, f"{path}/out", f"{path}/state", mode=mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def new_keys(df: DataFrame, keys: list[str], ts: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key a stream brings.

    Seen keys are kept in the stream's state, partitioned by key and, as the feeds set it, on disk: a batch touches the
    state of its own keys and never reads the sink. With ``ts`` and ``within`` a key is forgotten once the
    stream's event time has moved on so far: repeats within that time are dropped, later ones count as new, and rows older
    than it are dropped. Without them the
    state grows with the number of keys.
    """
    if (ts is None) != (within is None):
        raise ValueError("give both the event time and how long keys are to be remembered, or neither")
    if ts is None:
        return df.dropDuplicates(keys)
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def fan_out(sinks: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler that writes each micro-batch to several folders."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                kept.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        finally:
            kept.unpersist()

    return handle


def upsert_batches(sink: str, keys: list[str], version: str | None = None, compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler for a keyed upsert: each batch is written as a folder of changes.

    Every ``compact_every`` batches the newest rows are written as a base, so that
    ``current_rows`` reads one base and few changes, however old the stream is. What lies
    before the last base but one is then removed: readers that began before this base still
    find theirs. A repeated batch overwrites its own folders. Of rows of one key the highest ``version`` counts, then the later batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{sink}/changes/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            newest = _newest(spark, sink, batch.schema, keys, version, before=batch_id)
            newest.write.mode("overwrite").parquet(f"{sink}/base/upto={batch_id}")
            past = [n for n in finished(spark, f"{sink}/base", "upto") if n < batch_id]
            if past:
                remove_before(spark, f"{sink}/changes", "batch", past[-1] + 1)
                remove_before(spark, f"{sink}/base", "upto", past[-1])

    return handle


def _newest(spark: SparkSession, sink: str, schema: T.StructType, keys: list[str], version: str | None, before: int | None = None) -> DataFrame:
    """Newest row of each key with its batch, from the last base and the changes after it."""
    layout = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    bases = [n for n in finished(spark, f"{sink}/base", "upto") if before is None or n < before]
    start = bases[-1] if bases else -1
    parts = [f"{sink}/changes/batch={n}" for n in finished(spark, f"{sink}/changes", "batch") if n > start]
    rows = spark.read.schema(layout).option("basePath", f"{sink}/changes").parquet(*parts) if parts else spark.createDataFrame([], layout)
    if bases:
        rows = rows.unionByName(spark.read.schema(layout).parquet(f"{sink}/base/upto={start}"))
    return latest_per_key(rows, keys, [*([version] if version else []), "batch"])


def current_rows(spark: SparkSession, sink: str, schema: T.StructType, keys: list[str], version: str | None = None) -> DataFrame:
    """The newest row of each key of a table that ``upsert_batches`` writes."""
    return _newest(spark, sink, schema, keys, version).select(*schema.fieldNames())
