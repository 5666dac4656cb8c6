"""Latest-row, ranking, lag and session operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.dates import boundary_diff, epoch_micros
from shirabe.operators import skew

_UNORDERED = (T.MapType, T.VariantType)


def latest_per_key(
    df: DataFrame, keys: list[str], order: list[Column | str], ties: list[str] | None = None
) -> DataFrame:
    """First row of each key under ``order``; remaining columns break ties.

    Spark prunes each task to one row per key before the shuffle, so a key that
    holds a large part of the table sends only a row per task.
    """
    sort = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    spent = {*keys, *[c for c in order if isinstance(c, str)]}
    rest = ties if ties is not None else [
        f.name for f in df.schema.fields if f.name not in spent and not isinstance(f.dataType, _UNORDERED)
    ]
    sort += [F.col(c).asc_nulls_first() for c in rest]
    if not sort:
        # Every column is a key: rows of a key are alike.
        return df.dropDuplicates(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_except(df: DataFrame, excluded: list[str], order: list[Column | str]) -> DataFrame:
    """One row per value of all columns but ``excluded``, first under ``order``."""
    return latest_per_key(df, [c for c in df.columns if c not in excluded], order)


def with_group_stats(df: DataFrame, keys: list[str], value: str, unique: str) -> DataFrame:
    """Rank by falling ``value`` in the group, and the group average, on each row."""
    ranked = skew.add_row_number(skew.spread(df, keys, [value, unique], descending=True), "rank_in_group")
    averages = ranked.df.groupBy(*keys).agg(F.avg(value).alias("group_avg"))
    return skew.join_null_safe(ranked.rows(), averages, keys)


def with_change(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Previous value, change and percent change against the previous row."""
    out = skew.add_lag(skew.spread(df, keys, order), value, "prev_value").rows()
    change = F.col(value) - F.col("prev_value")
    percent = F.when(F.col("prev_value") > 0, change * 100.0 / F.col("prev_value")).otherwise(F.lit(0.0))
    return out.withColumns({"value_change": change, "change_percentage": percent})


def trend(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Label each row against the previous one of its group."""
    out = skew.add_lag(skew.spread(df, keys, order), value, "prev_value").rows()
    label = (
        F.when(F.col("prev_value").isNull(), "Initial Window")
        .when(F.col(value) > F.col("prev_value"), "Increasing Trend")
        .when(F.col(value) < F.col("prev_value"), "Decreasing Trend")
        .otherwise("Stable Trend")
    )
    return out.withColumns({"value_change": F.col(value) - F.col("prev_value"), "trend_direction": label})


def sessionize(
    df: DataFrame,
    user: list[str],
    ts: str,
    unique: str,
    gap_minutes: int = 30,
    *,
    exact: bool = False,
) -> DataFrame:
    """Session number per user.

    A session opens after more than ``gap_minutes`` minute boundaries or, with
    ``exact``, after a pause of at least that long.
    """
    s = skew.add_lag(skew.spread(df, user, [ts, unique]), ts, "_prev")
    if exact:
        pause = epoch_micros(F.col(ts)) - epoch_micros(F.col("_prev")) >= gap_minutes * 60_000_000
    else:
        pause = boundary_diff("minute", F.col("_prev"), F.col(ts)) > gap_minutes
    opened = F.coalesce(pause, F.lit(False))
    flagged = s.with_rows(s.df.withColumn("_opened", opened.cast("long")))
    return skew.add_running_sum(flagged, "_opened", "session_id").rows().drop("_prev", "_opened")


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Consecutive numbers over the whole frame, in order of a unique key."""
    s = skew.spread(df, [], order)
    return skew.add_row_number(s, name).rows()


def rate_exceeded(events: DataFrame, user: str, ts: str, window_seconds: int, limit: int) -> DataFrame:
    """Events with the calls their user made in the trailing window, and whether the limit held.

    Calls are first counted per (user, instant). Each count also stands as context
    in the following window-long cell, so a cell of one user is a task's work
    rather than the user's whole history.
    """
    size = window_seconds * 1_000_000
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    counts = events.groupBy(F.col(user), moment.alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    own = F.floor(F.col("_t") / size)
    cells = counts.withColumn("_cell", F.explode(F.array(own, own + 1))).withColumn("_own", F.col("_cell") == own)
    frame = Window.partitionBy(user, "_cell").orderBy("_t").rangeBetween(-(size - 1), 0)
    totals = cells.withColumn("recent_calls", F.sum("_n").over(frame)).filter("_own")
    return totals.select(
        user,
        F.timestamp_micros("_t").cast("timestamp_ntz").alias(ts),
        F.col("_n").alias("calls"),
        "recent_calls",
        (F.col("recent_calls") < limit).alias("within_limit"),
    )
