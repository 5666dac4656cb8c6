"""Writers: compressed extracts, JSON documents and table publication."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.dates import jst
from shirabe.session import stable

def _laid_out(df: DataFrame, files: int | None, order: list[str]) -> DataFrame:
    """Input with one partition per output file, sorted by range if an order is given.

    ``files`` is the caller's: 1 for a single file, a number of parts, or None for as many
    parts as Spark makes. The number of rows plays no part.
    """
    if files == 1:
        df = df.coalesce(1)
    elif order:
        df = df.repartitionByRange(*([files] if files else []), *order)
    elif files:
        df = df.repartition(files)
    return df.sortWithinPartitions(*order) if order else df


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def _rename_parts(spark: SparkSession, folder: str, name: str, suffix: str, single: bool) -> list[str]:
    """Give the part files of a write the agreed name: plain for a single file, else numbered."""
    path, fs = _file_system(spark, folder)
    parts = sorted(s.getPath().getName() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    out = []
    for i, part in enumerate(parts):
        target = f"{name}{suffix}" if single else f"{name}-{i:05d}{suffix}"
        _rename(fs, path(folder, part), path(folder, target))
        out.append(f"{folder}/{target}")
    return out


def write_csv_gz(
    df: DataFrame,
    folder: str,
    name: str,
    as_of: datetime | None = None,
    *,
    quote_all: bool = True,
    order: list[str] = (),
    files: int | None = None,
) -> list[str]:
    """Gzip CSV extract with header, quoted text and ``\\n`` row ends.

    Numbered parts, or with ``files=1`` one file, which one task then writes. An
    empty list still gives its header line. ``name`` may hold strftime fields,
    ``order`` names columns to sort the file (or the parts in turn) by.
    """
    name = jst(as_of).strftime(name) if as_of else name
    (
        _laid_out(df, files, list(order)).write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", "\\")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("lineSep", "\n")
        .option("compression", "gzip")
        .csv(folder)
    )
    return _rename_parts(df.sparkSession, folder, name, ".csv.gz", files == 1)


def write_json(
    df: DataFrame, folder: str, name: str, *, keep_nulls: bool = False, files: int | None = None
) -> list[str]:
    """JSON documents, one per line; numbered parts, or with ``files=1`` one file."""
    _laid_out(df, files, []).write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(folder)
    return _rename_parts(df.sparkSession, folder, name, ".json", files == 1)


def write_dated(df: DataFrame, folder: str, column: str = "dt") -> DataFrame:
    """Table partitioned by a day column; a day with many rows is written by several tasks."""
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_many(df: DataFrame, sinks: list[Callable[[DataFrame], object]]) -> list[object]:
    """One computed frame to several sinks; it is materialised once in the scratch folder."""
    kept = stable(df)
    return [sink(kept) for sink in sinks]


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions of a table, rising."""
    path, fs = _file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path(folder, "current"))] if fs.exists(path(folder, "current")) else []
    return sorted(int(n) for n in names if n.isdigit())


def current_path(spark: SparkSession, folder: str) -> str:
    """Folder of the newest published version of a table."""
    found = _versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"{folder} holds no published table")
    return f"{folder}/versions/{found[-1]:012d}"


def current_table(spark: SparkSession, folder: str) -> DataFrame:
    """The newest published version of a table."""
    return spark.read.parquet(current_path(spark, folder))


def _next_version(spark: SparkSession, folder: str) -> int:
    """A number above all versions, those left behind by a failed write included."""
    path, fs = _file_system(spark, folder)
    written = [int(s.getPath().getName()) for s in fs.listStatus(path(folder, "versions"))] if fs.exists(path(folder, "versions")) else []
    return max([0, *written, *_versions(spark, folder)]) + 1


def _point(spark: SparkSession, folder: str, version: int, keep: int) -> DataFrame:
    """Make a whole written version the current one.

    The pointer is an empty file named by the version, so it appears in one step on any store, and readers take the highest. Nothing a
    reader may have resolved is touched: the ``keep`` newest versions stay, older ones go, pointer first.
    """
    path, fs = _file_system(spark, folder)
    if not fs.exists(path(f"{folder}/versions/{version:012d}")):
        raise OSError(f"version {version} of {folder} does not exist")
    fs.create(path(f"{folder}/current/{version}"), False).close()
    oldest = _versions(spark, folder)[-keep:][0]
    for number in _versions(spark, folder):
        if number < oldest:
            fs.delete(path(f"{folder}/current/{number}"), False)
    for status in fs.listStatus(path(f"{folder}/versions")):
        if int(status.getPath().getName()) < oldest:
            fs.delete(status.getPath(), True)
    return current_table(spark, folder)


def overwrite_table(df: DataFrame, folder: str, keep: int = 2) -> DataFrame:
    """Full refresh: write a new version beside the old ones, then point to it.

    ``df`` may read the current version. Readers resolve the table with ``current_table``; at every moment they find a whole
    one, and a failed write leaves the old one in place. One writer at a time.
    """
    spark = df.sparkSession
    version = _next_version(spark, folder)
    df.write.parquet(f"{folder}/versions/{version:012d}")
    return _point(spark, folder, version, keep)


def append_table(df: DataFrame, folder: str) -> DataFrame:
    """Append the rows and return the whole table."""
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.parquet(folder)


class StageMismatch(ValueError):
    """The staged table does not hold the rows it was given."""


def publish(df: DataFrame, staging: str, main: str, key: str, keep: int = 2, plain: list[str] = ()) -> DataFrame:
    """Write to staging, check the stage, then move it into main as its next version.

    The stage must hold as many rows as were handed to the writer (counted on the
    way) and no key twice. The folder is moved, not copied, and main is readable throughout (``current_table``).
    ``plain`` names columns whose values hardly repeat: they are written without a dictionary, which would be given up
    after most of the time has gone into it.
    """
    spark = df.sparkSession
    given = Observation()
    options = {f"parquet.enable.dictionary#{c}": "false" for c in plain}
    df.observe(given, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(**options).parquet(staging)
    rows, keys = spark.read.parquet(staging).agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    if rows != given.get["n"] or keys != rows:
        raise StageMismatch(f"{staging}: {rows} rows, {keys} keys, {given.get['n']} rows written")
    version = _next_version(spark, main)
    path, fs = _file_system(spark, main)
    fs.mkdirs(path(f"{main}/versions"))
    _rename(fs, path(staging), path(f"{main}/versions/{version:012d}"))
    return _point(spark, main, version, keep)


def log_run(
    spark: SparkSession,
    folder: str,
    run_id: str,
    name: str,
    status: str,
    at: datetime,
    input_rows: int | None = None,
    output_rows: int | None = None,
    error: str | None = None,
) -> DataFrame:
    """Append one row per state change of a run; the current state is the newest row."""
    schema = (
        "run_id string, name string, status string, at timestamp_ntz, "
        "input_rows bigint, output_rows bigint, error string"
    )
    row = spark.createDataFrame([(run_id, name, status, at, input_rows, output_rows, error)], schema)
    return append_table(row, folder)
