"""Streams over several files, with late and repeated events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shirabe.operators.aggregate import count_rows
from shirabe.session import scratch_path
from shirabe.streaming import feeds, tables, windows

SCHEMA = "event_id bigint, user_id bigint, ts timestamp_ntz"


@pytest.fixture
def landing(spark):
    """Four files in order; the last repeats an event and brings one that is too late.

    With several stateful steps an event counts as late by the watermark of the
    batch before, hence the third file.
    """
    folder = scratch_path(spark, "landing")
    files = [
        [(1, 1, "2024-01-01 00:01:00"), (2, 2, "2024-01-01 00:04:00")],
        [(3, 1, "2024-01-01 00:40:00"), (4, 2, "2024-01-01 00:50:00")],
        [(6, 1, "2024-01-01 00:52:00")],
        [(4, 2, "2024-01-01 00:50:00"), (9, 1, "2024-01-01 00:02:00"), (5, 1, "2024-01-01 02:00:00")],
    ]
    for i, batch in enumerate(files):
        df = spark.createDataFrame(batch, "event_id bigint, user_id bigint, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture
def stream(spark, landing):
    schema = spark.createDataFrame([], SCHEMA).schema
    return feeds.read_events(spark, landing, schema, files_per_trigger=1)


def test_late_event_and_repeat_are_dropped(stream, rows):
    kept = feeds.with_late_policy(stream, "ts", "10 minutes", "event_id")
    out = feeds.drain(windows.windowed(kept, "ts", "5 minutes", [count_rows("n")]))
    got = [(str(s), n) for s, n in rows(out, "window_start", "n")]
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-01 00:40:00", 1), ("2024-01-01 00:50:00", 2)]


def test_sessions_close_after_the_gap(stream, rows):
    kept = feeds.with_late_policy(stream, "ts", "10 minutes", "event_id")
    out = feeds.drain(windows.session_windows(kept, "user_id", "ts", [count_rows("n")]))
    assert [(u, n) for u, n in rows(out, "user_id", "n")] == [(1, 1), (1, 2), (2, 1), (2, 1)]


def test_append_new_over_batches(spark, stream, rows):
    path = scratch_path(spark, "append")
    pairs = stream.select("user_id", F.hour("ts").alias("h"))
    feeds.feed(feeds.new_keys(pairs, ["user_id", "h"]), f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.schema(pairs.schema).parquet(f"{path}/out")
    assert rows(out, "user_id", "h") == [(1, 0), (1, 2), (2, 0)]


def test_upsert_keeps_the_newest_total(spark, stream, rows):
    path = scratch_path(spark, "upsert")
    totals = stream.groupBy("user_id").agg(count_rows("n"))
    handler = feeds.upsert_batches(f"{path}/t", ["user_id"], compact_every=2)
    feeds.feed_batches(totals, handler, f"{path}/state", mode="update").awaitTermination()
    assert tables.finished(spark, f"{path}/t/base", "upto") == [1, 3]
    assert rows(feeds.current_rows(spark, f"{path}/t", totals.schema, ["user_id"])) == [(1, 5), (2, 3)]


def test_fan_out_writes_the_same_rows(spark, stream):
    path = scratch_path(spark, "fan")
    feeds.feed_batches(stream, feeds.fan_out([f"{path}/a", f"{path}/b"]), f"{path}/state").awaitTermination()
    a, b = [spark.read.schema(stream.schema).parquet(f"{path}/{s}") for s in "ab"]
    assert a.count() == 8 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_upsert_takes_the_highest_version(spark, rows):
    path, schema = scratch_path(spark, "versions"), "k int, v int, at int"
    handle = feeds.upsert_batches(path, ["k"], "at", compact_every=2)
    for i, batch in enumerate([[(1, 10, 5), (2, 20, 1)], [(1, 11, 4)], [(2, 21, 1), (3, 30, 0)]]):
        handle(spark.createDataFrame(batch, schema), i)
    layout = spark.createDataFrame([], schema).schema
    assert rows(feeds.current_rows(spark, path, layout, ["k"], "at"), "k", "v") == [(1, 10), (2, 21), (3, 30)]


def test_exact_uniques(spark, stream, rows):
    kept = feeds.with_late_policy(stream, "ts", "10 minutes", "event_id")
    out = feeds.drain(windows.stream_uniques(kept, "ts", "10 minutes", "user_id"))
    assert [(str(s), n) for s, n in rows(out, "window_start", "unique_users")] == [("2024-01-01 00:00:00", 2), ("2024-01-01 00:40:00", 1), ("2024-01-01 00:50:00", 2)]


def provider(query):
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    return {k for p in progress for op in p["stateOperators"] for k in op["customMetrics"] if k.startswith("rocksdb")}


def test_state_is_on_disk_and_the_session_keeps_its_setting(spark, stream):
    path, before = scratch_path(spark, "disk"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = feeds.feed(feeds.new_keys(stream, ["user_id"]), f"{path}/out", f"{path}/state")
    query.awaitTermination()
    assert provider(query)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    again = feeds.feed_batches(stream.groupBy("user_id").agg(count_rows("n")), lambda batch, n: batch.collect(), f"{path}/other", mode="update")
    again.awaitTermination()
    assert provider(again)


def test_keys_are_forgotten_after_their_time(spark, rows):
    path = scratch_path(spark, "bounded")
    events = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 03:00:00"), (1, "2024-01-01 03:01:00")]
    for i, (user, at) in enumerate(events):
        df = spark.createDataFrame([(i, user, at)], "event_id bigint, user_id bigint, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(f"{path}/in")
        source = feeds.read_events(spark, f"{path}/in", spark.createDataFrame([], SCHEMA).schema)
        query = feeds.feed(feeds.new_keys(source, ["user_id"], "ts", "1 hour"), f"{path}/out", f"{path}/state")
        query.awaitTermination()
    # The second repeats the first within the hour; the last comes when the other user's event has moved time on.
    assert rows(spark.read.parquet(f"{path}/out"), "event_id") == [(0,), (2,), (3,)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    with pytest.raises(ValueError, match="neither"):
        feeds.new_keys(source, ["user_id"], ts="ts")


def test_trend_goes_on_from_the_batch_before(spark, rows):
    path = scratch_path(spark, "trend")
    handle = tables.carried(path, ["k"], "window_start", lambda df: windows.window_trend(df, ["k"], "n"))
    layout = "k string, window_start int, n long"
    batches = [[("a", 1, 5), ("a", 2, 7), ("b", 1, 1)], [("a", 3, 6)], [], [("a", 4, 6), ("b", 9, 2), (None, 1, 3)], [(None, 2, 3)]]
    expected = [
        ("a", 1, "Initial Window"), ("a", 2, "Increasing Trend"), ("a", 3, "Decreasing Trend"), ("a", 4, "Stable Trend"),
        ("b", 1, "Initial Window"), ("b", 9, "Increasing Trend"), (None, 1, "Initial Window"), (None, 2, "Stable Trend"),
    ]
    for i, batch in enumerate(batches):
        for _ in range(2):  # a batch that is repeated writes the same rows
            handle(spark.createDataFrame(batch, layout), i)
    found = spark.read.parquet(f"{path}/out")
    assert rows(found, "k", "window_start", "trend_direction") == sorted(expected, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert tables.finished(spark, f"{path}/last", "batch") == [3, 4]


def test_partials_merge_compact_and_repeat(spark, rows):
    path = scratch_path(spark, "partials")
    own = lambda df: df.groupBy("k").agg(count_rows("n"), F.max("v").alias("top"), tables.moments("v"))
    kept = tables.Partials(path, ["k"], own, {"n": F.sum("n"), "top": F.max("top"), "moments": tables.merge_moments()}, compact_every=3)
    data = [(i % 2, 1e9 + i * i % 7) for i in range(80)]
    layout = spark.createDataFrame([], "k int, v double")
    for i in range(8):
        for _ in range(2):
            kept.add(spark.createDataFrame(data[i * 10 : i * 10 + 10], "k int, v double"), i)
    assert tables.finished(spark, f"{path}/base", "upto") == [2, 5]
    assert tables.finished(spark, f"{path}/part", "batch") == [3, 4, 5, 6, 7]
    for upto in (7, None):
        found = kept.merged(spark, own(layout).schema, upto).collect()
        for r in found:
            values = [v for k, v in data if k == r.k]
            mean = sum(values) / len(values)
            assert (r.n, r.top) == (len(values), max(values))
            assert r.moments.mean == pytest.approx(mean) and r.moments.m2 == pytest.approx(sum((v - mean) ** 2 for v in values), rel=1e-4)
        assert len(found) == 2
    assert kept.merged(spark, own(layout).schema, -1).collect() == []


def test_moving_bounds_judge_by_what_was_known(spark):
    path = scratch_path(spark, "bounds")
    handle, current = windows.sensor_feed(path, ["k"], "v", "q", compact_every=2)
    layout = "k string, v double, q double"
    batches = [[("a", float(i % 5), 1.0) for i in range(50)], [("a", 100.0, 0.0), ("b", 1.0, None)], [("a", 100.0, 1.0)] * 50, [("a", None, 1.0)]]
    for i, batch in enumerate(batches):
        for _ in range(2):
            handle(spark.createDataFrame(batch, layout), i)
    found = {r.k: r for r in current(spark, spark.createDataFrame([], layout)).collect()}
    # 100 is odd when it comes first and no longer once half of all values are 100.
    assert (found["a"].measurement_count, found["a"].anomaly_count, found["a"].max_value) == (102, 1, 100.0)
    assert found["a"].avg_value == pytest.approx((100 + 51 * 100) / 101) and found["a"].avg_quality_score == pytest.approx(101 / 102)
    assert (found["b"].anomaly_count, found["b"].std_deviation, found["b"].avg_quality_score) == (0, None, None)


def test_triggers_add_up_over_batches(spark, rows):
    path, value, at = scratch_path(spark, "triggers"), F.col("v"), "at timestamp"
    rules = {"low": (None, value < 0, F.min, value, "at"), "high": (None, value > 10, F.max, value, "at")}
    busy = {"busy_alert": (None, F.col("c") >= 3, F.max, F.col("c"), "window_start")}
    handle, current = windows.trigger_feed(path, rules, {"busy": ("at", "5 minutes", busy)}, compact_every=2)
    read = lambda data: spark.createDataFrame(data, "v double, at string").withColumn("at", F.col("at").cast("timestamp"))
    for i, batch in enumerate([[(-1.0, "2024-01-01 00:01:00"), (11.0, "2024-01-01 00:02:00")], [], [(-3.0, "2024-01-01 00:03:00"), (12.0, "2024-01-01 00:09:00")]]):
        for _ in range(2):
            handle(read(batch), i)
    triggers = spark.createDataFrame([("low", "x"), ("high", "y"), ("busy_alert", "z"), ("none", "w")], "trigger_name string, action_description string")
    out = current(spark, read([]), triggers)
    assert rows(out, "trigger_name", "triggered_count", "max_trigger_value") == [("busy_alert", 1, 3.0), ("high", 2, 12.0), ("low", 2, -3.0)]


def test_upsert_removes_what_no_reader_needs(spark, rows):
    path, schema = scratch_path(spark, "old"), "k int, v int"
    handle = feeds.upsert_batches(path, ["k"], compact_every=2)
    for i in range(7):
        handle(spark.createDataFrame([(i % 3, i)], schema), i)
    assert tables.finished(spark, f"{path}/changes", "batch") == [4, 5, 6]
    assert tables.finished(spark, f"{path}/base", "upto") == [3, 5]
    layout = spark.createDataFrame([], schema).schema
    assert rows(feeds.current_rows(spark, path, layout, ["k"]), "k", "v") == [(0, 6), (1, 4), (2, 5)]
