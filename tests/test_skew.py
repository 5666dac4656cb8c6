"""Ordered work per group gives the rows of a plain window, with large groups divided."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shirabe.operators import skew, window


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one user, a third without a user; repeated and missing sort values."""
    n = F.col("id")
    user = F.when(n % 3 == 0, 7).when(n % 3 == 1, None).otherwise(n % 50)
    moment = F.timestamp_seconds((n * 7919) % 90000).cast("timestamp_ntz")
    return spark.range(6000).select(
        n.alias("event_id"),
        user.alias("user_id"),
        F.when(n % 97 == 0, None).otherwise(moment).alias("ts"),
        ((n * 31) % 40).cast("double").alias("score"),
    ).cache()


def same(rows, a, b):
    assert rows(a, *sorted(a.columns)) == rows(b, *sorted(a.columns))


def plain(keys, *order, descending=False):
    columns = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    return Window.partitionBy(*keys).orderBy(*columns)


def test_one_key_and_one_sort_value_spread_over_chunks(spark):
    alike = spark.range(4000).select(F.lit(7).alias("user_id"), F.lit(1.0).alias("score"), F.col("id").alias("event_id"))
    s = skew.spread(alike, ["user_id"], ["score", "event_id"])
    assert s.df.groupBy(skew.CHUNK).count().filter("count > 0").count() > 2
    numbered = window.with_group_stats(alike, ["user_id"], "score", "event_id")
    assert numbered.filter("rank_in_group <> 4000 - event_id or group_avg <> 1").isEmpty()


def test_large_groups_are_divided(hot):
    s = skew.spread(hot, ["user_id"], ["ts", "event_id"])
    assert s.df.groupBy("user_id").agg(F.countDistinct(skew.CHUNK).alias("n")).agg(F.max("n")).first()[0] > 1


def test_lag_and_change(rows, hot):
    w = plain(["user_id"], "ts", "event_id")
    change = F.col("score") - F.col("prev_value")
    percent = F.when(F.col("prev_value") > 0, change * 100.0 / F.col("prev_value")).otherwise(0.0)
    expected = hot.withColumn("prev_value", F.lag("score").over(w)).withColumns({"value_change": change, "change_percentage": percent})
    same(rows, expected, window.with_change(hot, ["user_id"], ["ts", "event_id"], "score"))


def test_trend(rows, hot):
    found = window.trend(hot, ["user_id"], ["ts", "event_id"], "score")
    expected = hot.withColumn("prev_value", F.lag("score").over(plain(["user_id"], "ts", "event_id")))
    assert rows(found, "event_id", "prev_value") == rows(expected, "event_id", "prev_value")
    assert found.filter("trend_direction = 'Initial Window'").count() == hot.select("user_id").distinct().count()


def test_sessionize(rows, hot):
    w = plain(["user_id"], "ts", "event_id")
    minutes = F.unix_timestamp(F.date_trunc("minute", F.col("ts").cast("timestamp"))) / 60
    opened = F.coalesce((minutes - F.lag(minutes).over(w)) > 2, F.lit(False)).cast("long")
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = hot.withColumn("_o", opened).withColumn("session_id", F.sum("_o").over(frame)).drop("_o")
    found = window.sessionize(hot, ["user_id"], "ts", "event_id", 2)
    same(rows, expected, found)
    assert found.agg(F.max("session_id")).first()[0] > 3


def test_rank_with_heavy_ties(rows, hot):
    w = plain(["user_id"], "score", "event_id", descending=True)
    expected = hot.withColumn("rank_in_group", F.row_number().over(w).cast("long"))
    found = window.with_group_stats(hot, ["user_id"], "score", "event_id")
    assert rows(expected, "event_id", "rank_in_group") == rows(found, "event_id", "rank_in_group")


def test_number_rows(hot, plan):
    found = window.number_rows(hot.select("event_id"), ["event_id"])
    assert found.filter("row_no <> event_id + 1").isEmpty()


def test_rate_limit_matches_plain_range_window(rows, hot):
    calls = hot.filter("ts IS NOT NULL AND user_id IS NOT NULL")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy("user_id").orderBy("_m").rangeBetween(-(600 * 1_000_000 - 1), 0)
    plain = calls.withColumn("_m", micros).withColumn("recent_calls", F.count(F.lit(1)).over(frame))
    plain = plain.select("user_id", "ts", "recent_calls").distinct()
    got = window.rate_exceeded(calls, "user_id", "ts", 600, 5)
    assert rows(plain, "user_id", "ts", "recent_calls") == rows(got, "user_id", "ts", "recent_calls")


def test_latest_per_key_prunes_before_the_shuffle(hot, plan):
    text = plan(window.latest_per_key(hot, ["user_id"], ["ts"]))
    assert text.count("WindowGroupLimit") == 2
