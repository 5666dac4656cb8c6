"""Readers: warehouse tables, SQL sources, delimited text, JSON and dated files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.dates import jst
from shirabe.functions.text import numbered

CORRUPT = "_corrupt_record"


class RejectedRows(ValueError):
    """More input rows were unreadable than the load allows."""


def read_table(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A warehouse table: Parquet below ``root``, or a catalog table."""
    return spark.read.parquet(f"{root}/{name}.parquet") if root else spark.table(name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition: dict[str, object] | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Result of a query run by the source database.

    ``partition`` gives column, lower, upper and count, so that the read is split
    over that many connections instead of one.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if not partition:
        return reader.option("query", query).load()
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition["column"])
        .option("lowerBound", partition["lower"])
        .option("upperBound", partition["upper"])
        .option("numPartitions", partition["count"])
        .load()
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    *,
    sep: str = ",",
    header: bool = False,
    quote: str = '"',
    escape: str = "\\",
    max_rejects: int | None = None,
    max_length: dict[str, int] | None = None,
) -> DataFrame:
    """Delimited text.

    Without a schema, columns come from the header and are typed by inference.
    With a schema and ``max_rejects``, rows with too few or too many columns,
    unreadable values or over-long text are counted, and the load fails if
    there are more than allowed; otherwise they are left out.
    """
    reader = (
        spark.read.option("sep", sep).option("header", header).option("quote", quote).option("escape", escape)
    )
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if max_rejects is None:
        return reader.schema(schema).csv(path)

    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = reader.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    # Whole rows are parsed whatever is selected later, or a short row would pass unseen.
    rows = rows.option("columnPruning", False).csv(path)
    # Spark refuses a query on the reject column alone (a plain count, say), so the
    # test also names a data column; a length is never negative.
    bad = F.col(CORRUPT).isNotNull() | (F.coalesce(F.length(F.col(schema.fields[0].name).cast("string")), F.lit(0)) < 0)
    for column, limit in (max_length or {}).items():
        bad = bad | (F.coalesce(F.length(column), F.lit(0)) > limit)
    checked = rows.withColumn("_bad", bad)
    rejects = checked.agg(F.count_if("_bad")).first()[0]
    if rejects > max_rejects:
        raise RejectedRows(f"{rejects} rows of {path} rejected, {max_rejects} allowed")
    return checked.filter("not _bad").drop("_bad", CORRUPT)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, *, multi_line: bool = False) -> DataFrame:
    """JSON documents, one per line or (``multi_line``) one per file."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def dated_path(template: str, as_of: datetime) -> str:
    """Path of the day: strftime fields of the template filled with the JST run day."""
    return jst(as_of).strftime(template)


def read_dated(df: DataFrame, as_of: datetime, column: str = "dt", fmt: str = "%Y%m%d") -> DataFrame:
    """Rows of the JST run day from a table partitioned by day (prunes partitions)."""
    return df.filter(F.col(column) == jst(as_of).strftime(fmt))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, **options: object) -> DataFrame:
    """The delimited file, or no rows of the same layout when it has not arrived."""
    if path_exists(spark, path):
        return read_delimited(spark, path, schema, **options)
    return spark.createDataFrame([], schema)


def scalar(df: DataFrame, column: str) -> object:
    """Value of ``column`` in the first row, None if there is none."""
    row = df.select(column).first()
    return row[0] if row else None


def values_df(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a table."""
    return spark.createDataFrame(rows, schema)


def generate_rows(base: DataFrame, seed: str, modulos: dict[str, int], *, prefix: str = "PERF_") -> DataFrame:
    """Numbered synthetic rows for volume tests, as many as ``base`` has.

    Row contents derive from a hash of the seed column, so a rerun or a retried
    task gives the same rows.
    """
    number = F.col(seed)
    columns = [
        F.concat(F.lit(prefix), numbered(number, 10)).alias("customer_id"),
        F.concat(F.lit("perf_test_"), number.cast("string"), F.lit("@example.com")).alias("email_address"),
        *[F.when(number % m == 0, F.concat(F.lit(f"{name}_"), number.cast("string"))).alias(name) for name, m in modulos.items()],
        F.sha2(F.concat(F.lit(prefix), number.cast("string")), 256).alias("code"),
    ]
    return base.select(*columns)
