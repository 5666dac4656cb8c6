"""Pages of a large sorted table, however deep, from the few files that hold them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"


def write_sorted(df: DataFrame, folder: str, order: list[str], ranges: int | None = None) -> None:
    """Write ``df`` sorted by range of ``order`` (rising, nulls first), with a directory of the rows in each range.

    ``order`` should be unique together: rows equal in it may lie on either side of a page's edge, the same at every read.
    """
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(count, *order).withColumn(PART, F.spark_partition_id()).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy(PART).parquet(f"{folder}/rows")
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")
    # Counted from the footers of the files just written.
    written = df.sparkSession.read.schema(f"{PART} int").parquet(f"{folder}/rows")
    counted = written.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    counted.coalesce(1).write.mode("overwrite").parquet(f"{folder}/directory")


def read_page(spark: SparkSession, folder: str, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` .. ``offset + size`` of a table that ``write_sorted`` laid out.

    The directory, a row per range, tells which ranges the page touches; only those are read, sorted and cut. What lies before
    the page is never opened, so a deep page costs what the first one does.
    """
    directory = sorted((r[PART], r["n"]) for r in spark.read.parquet(f"{folder}/directory").collect())
    ends = list(accumulate(n for _, n in directory))
    touched = [(part, end - n) for (part, n), end in zip(directory, ends, strict=True) if end > offset and end - n < offset + size]
    layout = spark.read.parquet(f"{folder}/layout")
    if not touched or size <= 0:
        return layout
    rows = spark.read.schema(layout.schema).parquet(*[f"{folder}/rows/{PART}={part}" for part, _ in touched])
    return rows.orderBy(*order).offset(offset - touched[0][1]).limit(size)
