"""Projections, filters and scalar column builders that work on whole frames."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.dates import add_months, jst, month_bounds


def project_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename ``{source: target}`` columns in one select; other columns are dropped."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])


def null_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Set (or add) retired columns to typed NULLs, keeping the column order."""
    kept = [F.lit(None).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    added = [F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in df.columns]
    return df.select(*kept, *added)


# Values one task makes and writes of a wide layout.
TASK_VALUES = 1 << 24


def dealt_for(df: DataFrame, columns: int, key: str) -> DataFrame:
    """Rows dealt by a unique key to as many tasks as ``columns`` columns made of each row call for.

    A file of narrow rows is one task however many there are. Spark sizes partitions by bytes read, so the
    rows are counted, and moved while they are narrow.
    """
    tasks = math.ceil(df.count() * columns / TASK_VALUES)
    return df.repartition(tasks, key) if tasks > 1 else df


def project_from_config(
    df: DataFrame, config: DataFrame, *, include_deprecated: bool = True, debug: bool = False
) -> DataFrame:
    """Projection whose retired columns come from a config table (alias_name, data_type).

    The config is a layout description: one row per output column, read once.
    """
    retired = {r["alias_name"]: r["data_type"] for r in config.select("alias_name", "data_type").toLocalIterator()}
    live = [c for c in df.columns if c not in retired]
    out = null_columns(df.select(*live), retired) if include_deprecated else df.select(*live)
    if debug:
        out.explain()
    return out


def stamp(df: DataFrame, as_of: datetime, **columns: str) -> DataFrame:
    """Add run-stamp columns: name=strftime pattern, evaluated on the JST run time."""
    run = jst(as_of)
    return df.withColumns({name: F.lit(run.strftime(fmt)) for name, fmt in columns.items()})


def _bound(df: DataFrame, column: str, day: datetime) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return F.lit(day.strftime("%Y%m%d"))
    if isinstance(dtype, T.DateType):
        return F.lit(day.date())
    return F.lit(day.strftime("%Y-%m-%d %H:%M:%S")).cast(dtype)


def date_window(
    df: DataFrame, column: str, as_of: datetime, from_days: int, to_days: int | None = None, closed: str = "left"
) -> DataFrame:
    """Keep rows dated from D-``from_days`` up to D-``to_days`` of the JST run day.

    ``closed='left'`` excludes the upper bound, ``'both'`` includes it; no
    ``to_days`` leaves the window open.
    """
    today = jst(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    keep = F.col(column) >= _bound(df, column, today - timedelta(days=from_days))
    if to_days is not None:
        upper = _bound(df, column, today - timedelta(days=to_days))
        keep = keep & (F.col(column) <= upper if closed == "both" else F.col(column) < upper)
    return df.filter(keep)


def current_month(df: DataFrame, column: str, as_of: datetime) -> DataFrame:
    """Rows dated in the calendar month of the JST run day."""
    first, following = month_bounds(jst(as_of))
    return df.filter((F.col(column) >= _bound(df, column, first)) & (F.col(column) < _bound(df, column, following)))


def before_month(df: DataFrame, column: str, as_of: datetime, months: int) -> DataFrame:
    """Rows dated before the first day of the JST run month minus ``months``."""
    first, _ = month_bounds(jst(as_of))
    return df.filter(F.col(column) < _bound(df, column, add_months(first, -months)))


def bucket(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """Label of the first threshold reached, thresholds given from high to low."""
    out = None
    for threshold, label in steps:
        out = F.when(value >= threshold, label) if out is None else out.when(value >= threshold, label)
    return out.otherwise(default)


def label_when(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """Label of the first condition that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(default).cast("string"))


def slot_lookup(code: str, types: list[str], keys: list[str]) -> Column:
    """Key of the first slot whose type equals ``code`` (NULL if that key is NULL)."""
    out = None
    for t, k in zip(types, keys):
        out = F.when(F.col(t) == code, F.col(k)) if out is None else out.when(F.col(t) == code, F.col(k))
    return out


def nest(df: DataFrame, keep: list[str], groups: dict[str, dict[str, Column]]) -> DataFrame:
    """Fold flat columns into one struct per group."""
    structs = [
        F.struct(*[c.alias(name) for name, c in fields.items()]).alias(group) for group, fields in groups.items()
    ]
    return df.select(*keep, *structs)


def stringify(df: DataFrame, columns: dict[str, str | None], null: str = "Null") -> DataFrame:
    """Format columns as text (``'%.5f'`` patterns or plain), NULL becoming ``null``."""

    def text(name: str, fmt: str | None) -> Column:
        c = F.col(name)
        shown = F.format_string(fmt, c.cast("double")) if fmt else c.cast("string")
        return F.when(c.isNull(), null).otherwise(shown).alias(name)

    return df.select(*[text(c, columns[c]) if c in columns else F.col(c) for c in df.columns])
