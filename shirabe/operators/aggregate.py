"""Aggregation helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def pct(num: Column, den: Column) -> Column:
    """Percentage; NULL instead of an error when the denominator is zero."""
    return F.try_divide(num * F.lit(100.0), den.cast("double"))


def money(value: Column, scale: int = 6) -> Column:
    """Amount with ``scale`` decimals, so that sums do not depend on the order of rows.

    ``scale`` must fit the column: further decimals are rounded.
    """
    return value.cast(f"decimal(32,{scale})")


def mean_amount(value: Column, scale: int = 6) -> Column:
    """Average of amounts by way of their sum at ``scale`` decimals."""
    return F.try_divide(F.sum(money(value, scale)).cast("double"), F.count(value).cast("double"))


def flag_pivot(df: DataFrame, keys: list[str], code: str, flags: dict[str, str]) -> DataFrame:
    """'1'/'0' per code and key: does any row of the key carry the code."""
    # Numbers aggregate in a hash table, texts would have to be sorted first.
    columns = [F.max(F.when(F.col(code) == c, 1).otherwise(0)).cast("string").alias(f) for c, f in flags.items()]
    return df.groupBy(*keys).agg(*columns)


def collapse_flags(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Merge per-type flag rows into one row per key, keeping the highest flag."""
    merged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    flags = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in flags])


def string_agg(df: DataFrame, keys: list[str], column: str, name: str, sep: str = ", ", *, distinct: bool = False) -> DataFrame:
    """Values of a column as one ordered text per group, with repeats unless ``distinct``.

    The text is as long as the group: use ``distinct`` for code columns of large
    groups, whose values are then made distinct before they are gathered.
    """
    rows = df.select(*keys, column)
    text = F.expr(f"listagg(cast(`{column}` as string), '{sep}') within group (order by `{column}`)")
    return (rows.distinct() if distinct else rows).groupBy(*keys).agg(text.alias(name))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of non-NULL values per column, one row."""
    total = F.count(F.lit(1))
    parts = [pct(F.count(c), total).alias(f"{c}_coverage_pct") for c in columns]
    return df.agg(*parts, total.alias("total_records"))


def size_stats(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Length statistics of a text column by group."""
    size = F.length(text)
    return df.groupBy(*keys).agg(
        count_rows("record_count"),
        F.avg(size).alias("avg_record_size"),
        F.max(size).cast("long").alias("max_record_size"),
        F.min(size).cast("long").alias("min_record_size"),
        F.sum(size).cast("long").alias("total_data_size"),
    )


def duplicates(df: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """Keys that occur more than once, with their first and last id."""
    return (
        df.groupBy(*keys)
        .agg(count_rows("duplicate_count"), F.min(unique).alias("first_id"), F.max(unique).alias("last_id"))
        .filter("duplicate_count > 1")
    )


def id_bitmaps(df: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """Exact distinct ids per group as bitmaps: a row per group and 32,768 consecutive ids.

    ``unique`` is an integer; null ids count for nothing. Bitmaps of days can be stored and joined to
    months and years without a second look at the rows. A bitmap takes 4 KB however few of its bits are set, so ids should be dense;
    number sparse ones first.
    """
    given = df.filter(F.col(unique).isNotNull()).withColumn("_id", F.col(unique).cast("bigint"))
    cells = given.groupBy(*keys, F.bitmap_bucket_number("_id").alias("id_range"))
    return cells.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("ids"))


def merge_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of coarser groups from those of finer ones."""
    return bitmaps.groupBy(*keys, "id_range").agg(F.bitmap_or_agg("ids").alias("ids"))


def distinct_of_bitmaps(bitmaps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Exact distinct ids of each group, over all its ranges of ids."""
    merged = merge_bitmaps(bitmaps, keys)
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("ids")).alias(name))
