"""Tables that a stream keeps beside its sink: partial aggregates and carried rows.

Each micro-batch writes a folder of its own, named by its number, and reads only folders
of earlier batches. A batch that is repeated after a failure therefore overwrites what it wrote
and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.operators.window import latest_per_key

Handler = Callable[[DataFrame, int], None]


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the finished folders ``name=<n>``, rising."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    found = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(path(p, "_SUCCESS")))


def remove_before(spark: SparkSession, folder: str, name: str, number: int) -> None:
    """Remove the folders ``name=<n>`` below a number."""
    path, fs = _fs(spark, folder)
    if fs.exists(path(folder)):
        for status in fs.listStatus(path(folder)):
            found = status.getPath()
            if found.getName().startswith(f"{name}=") and int(found.getName().split("=")[1]) < number:
                fs.delete(found, True)


class Partials:
    """Partial aggregates of a stream, a folder per batch, merged on read.

    ``partial`` aggregates a batch to a row per key; ``merge`` names, per column, the aggregate that joins rows of
    one key. It must give the same however rows are grouped (sums, extremes, merged moments). Every
    ``compact_every`` batches the parts are merged to a base. Folders are removed one base later, so neither a reader that
    has begun nor a repeated batch misses one; a read opens one base and fewer than twice that many parts.
    """

    def __init__(self, folder: str, keys: list[str], partial: Callable[[DataFrame], DataFrame], merge: dict[str, Column], compact_every: int = 20):
        self.folder, self.keys, self.partial, self.merge, self.compact_every = folder, keys, partial, merge, compact_every

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Write the partial aggregates of a batch; the handler for ``feed_batches``."""
        spark, rows = batch.sparkSession, self.partial(batch)
        rows.write.mode("overwrite").parquet(f"{self.folder}/part/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.merged(spark, rows.schema, batch_id).write.mode("overwrite").parquet(f"{self.folder}/base/upto={batch_id}")
            past = [n for n in finished(spark, f"{self.folder}/base", "upto") if n < batch_id]
            if past:
                remove_before(spark, f"{self.folder}/part", "batch", past[-1] + 1)
                remove_before(spark, f"{self.folder}/base", "upto", past[-1])

    def merged(self, spark: SparkSession, schema: T.StructType, upto: int | None = None) -> DataFrame:
        """One row per key over all batches (or those up to a number). Empty before the first batch."""
        bases = [n for n in finished(spark, f"{self.folder}/base", "upto") if upto is None or n < upto]
        start = bases[-1] if bases else -1
        parts = [n for n in finished(spark, f"{self.folder}/part", "batch") if n > start and (upto is None or n <= upto)]
        paths = [*[f"{self.folder}/base/upto={n}" for n in bases[-1:]], *[f"{self.folder}/part/batch={n}" for n in parts]]
        rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        grouped = rows.groupBy(*self.keys) if self.keys else rows.groupBy()
        return grouped.agg(*[how.alias(c) for c, how in self.merge.items()]).select(*schema.fieldNames())


def moments(value: str, name: str = "moments") -> Column:
    """Count, mean and sum of squared distances from the mean, as one struct; null values do not count."""
    n, mean = F.count(value), F.avg(value)
    return F.struct(
        n.alias("n"), F.coalesce(mean, F.lit(0.0)).cast("double").alias("mean"), F.coalesce(F.var_pop(value) * n, F.lit(0.0)).cast("double").alias("m2")
    ).alias(name)


def merge_moments(column: str = "moments") -> Column:
    """Moments of all rows from moments of parts, joined pair by pair.

    The difference of two means counts, not the difference of large sums of squares, so nothing cancels. A key has one part per batch
    since the last base; they are joined in a fixed order.
    """

    def join(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
        gap = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"))

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.sort_array(F.collect_list(column)), zero, join)


def bounds(found: Column, k: float = 2) -> tuple[Column, Column]:
    """Mean less and plus ``k`` sample deviations of moments; null below two values."""
    reach = F.when(found["n"] > 1, k * F.sqrt(found["m2"] / (found["n"] - 1)))
    return found["mean"] - reach, found["mean"] + reach


def with_moving_bounds(folder: str, keys: list[str], value: str, extra: dict[str, tuple[Column, Column]], k: float = 2, compact_every: int = 20):
    """Statistics per key of a stream and the rows outside the bounds known when they came.

    Returns the handler and a reader. Each batch first adds its moments (and ``extra`` columns: how a batch is aggregated, how parts
    merge), then counts its rows outside mean ± ``k`` deviations of everything up to and including itself. Both tables are merged
    on read: a row per key with ``moments``, the extra columns and ``anomaly_count``.
    """
    own = [moments(value), *[how.alias(c) for c, (how, _) in extra.items()]]
    stats = Partials(
        f"{folder}/stats", keys, lambda rows: rows.groupBy(*keys).agg(*own), {"moments": merge_moments(), **{c: m for c, (_, m) in extra.items()}}, compact_every
    )
    outside = Partials(f"{folder}/outside", keys, lambda rows: rows, {"anomaly_count": F.sum("anomaly_count")}, compact_every)

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.select(*keys, value, *[c for c in batch.columns if c not in (*keys, value)]).persist()
        try:
            stats.add(kept, batch_id)
            schema = stats.partial(kept).schema
            low, high = bounds(F.col("moments"), k)
            known = stats.merged(batch.sparkSession, schema, batch_id).select(*keys, low.alias("_low"), high.alias("_high"))
            judged = kept.select(*keys, value).join(known, keys)
            counts = judged.groupBy(*keys).agg(F.count_if((F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))).alias("anomaly_count"))
            outside.add(counts, batch_id)
        finally:
            kept.unpersist()

    def current(spark: SparkSession, layout: DataFrame) -> DataFrame:
        """Statistics so far; ``layout`` has the columns of the stream."""
        counts = T.StructType([*[layout.schema[c] for c in keys], T.StructField("anomaly_count", T.LongType())])
        return stats.merged(spark, stats.partial(layout).schema).join(outside.merged(spark, counts), keys)

    return handle, current


def carried(folder: str, keys: list[str], order: str, label: Callable[[DataFrame], DataFrame]) -> Handler:
    """Handler that labels each row against the one before it, also if that came in an earlier batch.

    Rows of a key must come in rising ``order`` from batch to batch, as closed windows of a stream do. The last row of each key is
    carried on in a table with a version per batch: batch n reads the newest version below n and writes version n, then
    ``out/batch=n``. ``label`` gets the batch with the carried rows in front and may look back one row; carried rows are not written again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = [n for n in finished(spark, f"{folder}/last", "batch") if n < batch_id]
        fresh = batch.withColumn("_carried", F.lit(False)).persist()
        try:
            rows = fresh
            if versions:
                before = spark.read.schema(batch.schema).parquet(f"{folder}/last/batch={versions[-1]}")
                rows = before.withColumn("_carried", F.lit(True)).unionByName(fresh)
            # One row per key is written and read again, so the chain of batches is cut here.
            latest_per_key(rows.drop("_carried"), keys, [order]).write.mode("overwrite").parquet(f"{folder}/last/batch={batch_id}")
            label(rows).filter(~F.col("_carried")).drop("_carried").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
            # A batch is repeated only while it is the newest: the version before it stays.
            remove_before(spark, f"{folder}/last", "batch", versions[-1] if versions else 0)
        finally:
            fresh.unpersist()

    return handle
