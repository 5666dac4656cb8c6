"""Sorting, paging, set operations and unpivoting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows under a total order."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` .. ``offset+size`` under a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def priority_order(column: str, ranking: list[str]) -> Column:
    """Sort position of a label in a given ranking; unknown labels come last."""
    out = F.lit(len(ranking) + 1)
    for position, label in reversed(list(enumerate(ranking, start=1))):
        out = F.when(F.col(column) == label, position).otherwise(out)
    return out


def schema_only(df: DataFrame) -> DataFrame:
    """The layout of ``df`` without rows."""
    return df.limit(0)


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def unpivot_slots(df: DataFrame, keep: list[str], slots: list[tuple[str, str]]) -> DataFrame:
    """(keep…, key_type, key) rows, one per slot, from a single scan."""
    entries = F.array(*[F.struct(F.col(t).alias("key_type"), F.col(k).alias("key")) for t, k in slots])
    return df.select(*keep, F.explode(entries).alias("_slot")).select(*keep, "_slot.key_type", "_slot.key")


def above_avg(df: DataFrame, value: str, where: Column) -> DataFrame:
    """Rows whose value exceeds the average over the rows meeting ``where``.

    The average is one number: it is brought to the rows as a scalar subquery.
    """
    mean = df.filter(where).agg(F.avg(value)).scalar()
    return df.filter(F.col(value) > mean)
