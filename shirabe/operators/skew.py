"""Ordered per-group work that survives a group holding a large part of all rows.

Rows are sorted by range of the keys and all sort columns and written once with the
number of their range, the chunk. Windows run per (group, chunk), and a small table of
per-chunk totals is carried over. Groups of any size take this path; a group larger
than a range has several chunks, also if its rows tie in all but the last sort column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shirabe.session import stored

CHUNK = "_chunk"


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on all keys in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys in which NULL equals NULL; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


@dataclass
class Spread:
    """Rows with a chunk number that rises in sort order within each group."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    descending: bool

    def window(self) -> WindowSpec:
        columns = [F.col(c).desc_nulls_last() if self.descending else F.col(c).asc_nulls_first() for c in self.order]
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*columns)

    def with_rows(self, df: DataFrame) -> Spread:
        return replace(self, df=df)

    def carry(self, totals: DataFrame, value: Column, name: str) -> DataFrame:
        """Join ``value``, computed over the chunk totals in order, back to the rows.

        Only chunks after a group's first have something to carry: at most one row
        per range and group that crosses its start.
        """
        prior = totals.select(*self.keys, CHUNK, value.alias(name)).filter(F.col(name).isNotNull())
        return join_null_safe(self.df, prior, [*self.keys, CHUNK])

    def chunk_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK)


def spread(df: DataFrame, keys: list[str], order: list[str], *, descending: bool = False) -> Spread:
    """Prepare ``df`` for ordered work per group.

    All columns of ``order`` are read in the same direction, NULLs first (ascending)
    or last (descending). The number of ranges is that of shuffle partitions.
    """
    chunk = F.spark_partition_id()
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, *keys, *order).withColumn(CHUNK, -chunk if descending else chunk)
    return Spread(stored(ranged, "ranges"), keys, order, descending)


def add_row_number(s: Spread, name: str) -> Spread:
    """Position of each row in its group, from 1."""
    numbered = s.with_rows(s.df.withColumn(name, F.row_number().over(s.window()).cast("long")))
    totals = s.df.groupBy(*s.keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(s.chunk_window().rowsBetween(Window.unboundedPreceding, -1))
    out = numbered.carry(totals, before, "_before")
    return s.with_rows(out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before"))


def add_lag(s: Spread, column: str, name: str) -> Spread:
    """Value of ``column`` in the previous row of the group."""
    lagged = s.df.withColumn(name, F.lag(column).over(s.window()))
    first = s.with_rows(lagged.withColumn("_first", F.row_number().over(s.window()) == 1))
    # The last row of a chunk; NULL sorts lowest in a struct as it does in the window.
    last = F.min_by if s.descending else F.max_by
    totals = s.df.groupBy(*s.keys, CHUNK).agg(last(column, F.struct(*s.order)).alias("_c"))
    out = first.carry(totals, F.lag("_c").over(s.chunk_window()), "_prior")
    value = F.when(F.col("_first"), F.col("_prior")).otherwise(F.col(name))
    return s.with_rows(out.withColumn(name, value).drop("_first", "_prior"))


def add_running_sum(s: Spread, column: str, name: str) -> Spread:
    """Sum of ``column`` over the rows of the group up to and including this one."""
    frame = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = s.with_rows(s.df.withColumn(name, F.sum(column).over(frame)))
    totals = s.df.groupBy(*s.keys, CHUNK).agg(F.sum(column).alias("_t"))
    before = F.sum("_t").over(s.chunk_window().rowsBetween(Window.unboundedPreceding, -1))
    out = summed.carry(totals, before, "_before")
    return s.with_rows(out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before"))

