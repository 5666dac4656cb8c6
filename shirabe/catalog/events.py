"""Event analytics, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.catalog.registry import Tables, query
from shirabe.functions.jsonx import json_amount
from shirabe.operators.aggregate import count_rows
from shirabe.operators.window import rate_exceeded
from shirabe.session import scratch_path
from shirabe.sources.readers import values_df
from shirabe.streaming import feeds, tables, windows

EPOCH = "TIMESTAMP '1970-01-01'"


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def amount() -> Column:
    return json_amount(F.col("props"), "$.k").cast("double")


AMOUNT = "CAST(try_cast(json_extract_string(props, '$.k') AS DECIMAL(10,2)) AS DOUBLE)"
PURCHASES = f"""count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase_events,
  avg(CASE WHEN event_type = 'purchase' THEN {AMOUNT} END) AS avg_purchase_amount"""


@query(
    "ev_throughput",
    """WITH a AS (SELECT event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, min(ts) AS first_event,
         max(ts) AS last_event, date_diff('second', min(ts), max(ts)) AS time_span_seconds, avg(length(props)) AS size FROM events GROUP BY 1)
       SELECT event_type, event_count, unique_users, first_event, last_event, time_span_seconds, round(size, 2) AS avg_event_size_bytes,
         round(event_count * 3600.0::DOUBLE / time_span_seconds, 4) AS events_per_hour,
         round(event_count * size / time_span_seconds / 1024, 6) AS kb_per_second,
         CASE WHEN event_count * 1.0 / time_span_seconds >= 10 THEN 'High Throughput' WHEN event_count * 1.0 / time_span_seconds >= 5
           THEN 'Medium Throughput' WHEN event_count * 1.0 / time_span_seconds >= 1 THEN 'Low Throughput' ELSE 'Very Low Throughput' END
           AS throughput_category FROM a""",
)
def ev_throughput(t: Tables) -> DataFrame:
    out = windows.throughput(t.events, "event_type", "ts", "user_id", "props")
    out = out.withColumn("events_per_hour", F.round(F.col("event_count") * 3600.0 / F.col("time_span_seconds"), 4))
    return rounded(rounded(out, 2, "avg_event_size_bytes"), 6, "kb_per_second").drop("events_per_second")


@query(
    "ev_sensor_stats",
    """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d,
         min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(1 - l_discount) AS q FROM lineitem GROUP BY 1, 2),
       a AS (SELECT s.*, (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = s.l_returnflag AND l.l_linestatus = s.l_linestatus
         AND (l_extendedprice > m + 2 * d OR l_extendedprice < m - 2 * d)) AS out FROM s)
       SELECT l_returnflag, l_linestatus, n AS measurement_count, round(m, 2) AS avg_value, round(d, 2) AS std_deviation, lo AS min_value,
         hi AS max_value, round(q, 3) AS avg_quality_score, out AS anomaly_count, round(out * 100.0::DOUBLE / n, 1) AS anomaly_percentage,
         CASE WHEN q >= 0.95 THEN 'Excellent' WHEN q >= 0.9 THEN 'Good' WHEN q >= 0.8 THEN 'Fair' ELSE 'Poor' END AS data_quality_rating,
         CASE WHEN round(out * 100.0::DOUBLE / n, 1) <= 2 THEN 'Normal Operation' WHEN round(out * 100.0::DOUBLE / n, 1) <= 5 THEN 'Minor Issues'
           WHEN round(out * 100.0::DOUBLE / n, 1) <= 10 THEN 'Significant Issues' ELSE 'Critical Issues' END AS anomaly_status FROM a""",
)
def ev_sensor_stats(t: Tables) -> DataFrame:
    readings = t.lineitem.withColumn("quality", 1 - F.col("l_discount"))
    out = windows.sensor_stats(readings, ["l_returnflag", "l_linestatus"], "l_extendedprice", "quality")
    out = rounded(rounded(out, 2, "avg_value", "std_deviation"), 3, "avg_quality_score")
    return rounded(out, 1, "anomaly_percentage").drop("upper_threshold", "lower_threshold")


TUMBLING = f"""tumbling AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, {EPOCH}) AS window_start, count(*) AS event_count,
  count(DISTINCT user_id) AS unique_users, {PURCHASES} FROM events GROUP BY 1)"""

SLIDING = f"""hops AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, {EPOCH}) - INTERVAL 5 MINUTE * h AS window_start, *
    FROM events, (SELECT unnest([0, 1]) AS h)),
  sliding AS (SELECT window_start, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, {PURCHASES} FROM hops GROUP BY 1)"""


def _tumbling(t: Tables) -> DataFrame:
    aggs = [*windows.event_aggs("event_type", amount()), windows.uniques("user_id")]
    return windows.windowed(t.events, "ts", "5 minutes", aggs)


def _sliding(t: Tables) -> DataFrame:
    aggs = [*windows.event_aggs("event_type", amount()), windows.uniques("user_id")]
    return windows.windowed(t.events, "ts", "10 minutes", aggs, slide="5 minutes")


@query(
    "ev_tumbling",
    f"""WITH {TUMBLING} SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, event_count, unique_users, purchase_events,
        round(avg_purchase_amount, 4) AS avg_purchase_amount FROM tumbling""",
)
def ev_tumbling(t: Tables) -> DataFrame:
    return rounded(_tumbling(t), 4, "avg_purchase_amount")


@query(
    "ev_sliding",
    f"""WITH {SLIDING} SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, event_count, unique_users, purchase_events,
        round(avg_purchase_amount, 4) AS avg_purchase_amount FROM sliding""",
)
def ev_sliding(t: Tables) -> DataFrame:
    return rounded(_sliding(t), 4, "avg_purchase_amount")


@query(
    "ev_uniques",
    f"""SELECT time_bucket(INTERVAL 10 MINUTE, ts, {EPOCH}) AS window_start, event_type, count(DISTINCT user_id) AS unique_users
        FROM events GROUP BY 1, 2""",
)
def ev_uniques(t: Tables) -> DataFrame:
    return windows.windowed(t.events, "ts", "10 minutes", [windows.uniques("user_id")], ["event_type"]).drop("window_end")


@query(
    "ev_json_amount",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) AS window_start, count({AMOUNT}) AS n, sum({AMOUNT}) AS total,
        max({AMOUNT}) AS top FROM events GROUP BY 1""",
)
def ev_json_amount(t: Tables) -> DataFrame:
    aggs = [F.count(amount()).alias("n"), F.sum(amount()).alias("total"), F.max(amount()).alias("top")]
    return windows.windowed(t.events, "ts", "1 hour", aggs).drop("window_end")


BOTH = f"""{TUMBLING}, {SLIDING}, every_window AS (
  SELECT 'Tumbling_5min' AS window_type, 5 AS minutes, * FROM tumbling UNION ALL SELECT 'Sliding_10min_5min', 10, * FROM sliding)"""


def _both(t: Tables) -> DataFrame:
    first = _tumbling(t).withColumns({"window_type": F.lit("Tumbling_5min"), "minutes": F.lit(5)})
    second = _sliding(t).withColumns({"window_type": F.lit("Sliding_10min_5min"), "minutes": F.lit(10)})
    return first.unionByName(second)


@query(
    "ev_window_metrics",
    f"""WITH {BOTH} SELECT window_type, window_start, event_count, round(coalesce(avg_purchase_amount, 0), 2) AS avg_purchase_amount,
        round(event_count * 1.0::DOUBLE / minutes, 4) AS events_per_minute,
        round(purchase_events * 100.0::DOUBLE / event_count, 4) AS purchase_conversion_rate,
        CASE WHEN event_count >= 20 THEN 'High Volume Window' WHEN event_count >= 10 THEN 'Medium Volume Window'
          WHEN event_count >= 5 THEN 'Low Volume Window' ELSE 'Very Low Volume Window' END AS volume_category FROM every_window""",
)
def ev_window_metrics(t: Tables) -> DataFrame:
    out = windows.window_metrics(_both(t), F.col("minutes"))
    out = rounded(rounded(out, 2, "avg_purchase_amount"), 4, "events_per_minute", "purchase_conversion_rate")
    return out.select(
        "window_type", "window_start", "event_count", "avg_purchase_amount", "events_per_minute", "purchase_conversion_rate", "volume_category"
    )


@query(
    "ev_window_trend",
    f"""WITH {BOTH} SELECT window_type, window_start, event_count, lag(event_count) OVER w AS prev_value,
        event_count - lag(event_count) OVER w AS value_change, CASE WHEN lag(event_count) OVER w IS NULL THEN 'Initial Window'
          WHEN event_count > lag(event_count) OVER w THEN 'Increasing Trend' WHEN event_count < lag(event_count) OVER w
          THEN 'Decreasing Trend' ELSE 'Stable Trend' END AS trend_direction
        FROM every_window WINDOW w AS (PARTITION BY window_type ORDER BY window_start)""",
)
def ev_window_trend(t: Tables) -> DataFrame:
    out = windows.window_trend(_both(t).select("window_type", "window_start", "event_count"), ["window_type"])
    return out


@query(
    "ev_window_alerts",
    f"""WITH m AS (SELECT 'Streaming Events' AS category, time_bucket(INTERVAL 5 MINUTE, ts, {EPOCH}) AS window_start, count(*) AS n
          FROM events GROUP BY 2 UNION ALL
          SELECT 'Sensor Readings', time_bucket(INTERVAL 10 MINUTE, ts, {EPOCH}), count(*) FROM events WHERE value > 10 GROUP BY 2),
        c AS (SELECT *, lag(n) OVER w AS prev_value, n - lag(n) OVER w AS value_change,
          (n - lag(n) OVER w) * 100.0::DOUBLE / lag(n) OVER w AS p FROM m WINDOW w AS (PARTITION BY category ORDER BY window_start))
        SELECT category, window_start, n, prev_value, value_change, round(p, 1) AS change_percentage,
          CASE WHEN abs(p) >= 50 THEN 'Critical Alert' WHEN abs(p) >= 25 THEN 'Warning Alert' WHEN abs(p) >= 10 THEN 'Information Alert'
            ELSE 'Normal' END AS alert_level,
          CASE WHEN n >= 20 THEN 'High Activity' WHEN n >= 10 THEN 'Medium Activity' WHEN n >= 5 THEN 'Low Activity'
            ELSE 'Very Low Activity' END AS activity_level FROM c WHERE prev_value IS NOT NULL""",
)
def ev_window_alerts(t: Tables) -> DataFrame:
    five = windows.windowed(t.events, "ts", "5 minutes", [count_rows("n")]).withColumn("category", F.lit("Streaming Events"))
    ten = windows.windowed(t.events.filter("value > 10"), "ts", "10 minutes", [count_rows("n")])
    metrics = five.unionByName(ten.withColumn("category", F.lit("Sensor Readings"))).drop("window_end")
    out = windows.window_alerts(metrics, ["category"], ["window_start"], "n")
    return rounded(out, 1, "change_percentage")


SESSIONS = f"""flagged AS (SELECT *, CASE WHEN date_diff('minute', lag(ts) OVER w, ts) > 30 THEN 1 ELSE 0 END AS o
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  tagged AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_id FROM flagged),
  sessions AS (SELECT user_id, session_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS total_events,
    count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
    count(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys, coalesce(sum({AMOUNT}), 0) AS total_purchase_amount,
    date_diff('minute', min(ts), max(ts)) AS session_duration_minutes FROM tagged GROUP BY 1, 2)"""


def _sessions(t: Tables) -> DataFrame:
    counted = {"view": "views", "click": "clicks", "purchase": "buys"}
    return windows.sessions(t.events, "user_id", "ts", "event_id", windows.session_aggs("event_type", counted, amount()))


@query("ev_sessions", f"WITH {SESSIONS} SELECT * FROM sessions")
def ev_sessions(t: Tables) -> DataFrame:
    return _sessions(t)


@query(
    "ev_session_windows",
    """WITH f AS (SELECT user_id, ts, value, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS o
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM f)
       SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def ev_session_windows(t: Tables) -> DataFrame:
    return windows.session_windows(t.events, "user_id", "ts", [count_rows("n")])


@query(
    "ev_session_patterns",
    f"""WITH {SESSIONS}, labelled AS (SELECT *, CASE WHEN views >= 3 AND clicks >= 2 AND buys >= 1 THEN 'High Engagement Purchase'
          WHEN views >= 5 AND clicks >= 3 AND buys = 0 THEN 'High Engagement No Purchase' WHEN views >= 2 AND buys >= 1 THEN 'Quick Purchase'
          WHEN views >= 10 AND clicks >= 5 THEN 'Extensive Browsing' WHEN total_events = 1 AND views = 1 THEN 'Single Page View'
          ELSE 'Standard Session' END AS session_pattern,
          CASE WHEN session_duration_minutes > 120 THEN 'Unusually Long Session'
          WHEN session_duration_minutes < 1 AND total_events > 5 THEN 'Rapid Fire Events' WHEN clicks > views * 3 THEN 'Excessive Clicking'
          WHEN buys > 0 AND session_duration_minutes < 2 THEN 'Suspiciously Quick Purchase' ELSE 'Normal Behavior' END AS anomaly_pattern
        FROM sessions),
        p AS (SELECT session_pattern, anomaly_pattern, count(*) AS pattern_count, avg(total_events) AS e, avg(session_duration_minutes) AS d,
          sum(buys) AS b, sum(total_purchase_amount) AS r, avg(total_purchase_amount) AS a,
          count(CASE WHEN buys > 0 THEN 1 END) * 100.0::DOUBLE / count(*) AS c, avg(views + clicks) AS g FROM labelled GROUP BY 1, 2)
        SELECT session_pattern, anomaly_pattern, pattern_count, round(e, 4) AS avg_events_per_session,
          round(d, 4) AS avg_session_duration_minutes, CAST(b AS BIGINT) AS total_purchases, round(r, 2) AS total_revenue,
          round(a, 4) AS avg_purchase_amount, round(c, 4) AS conversion_rate_percent, round(g, 4) AS avg_engagement_actions,
          CASE WHEN session_pattern LIKE '%Purchase%' AND c >= 50 THEN 'High Value Pattern' WHEN session_pattern LIKE '%Engagement%'
            THEN 'Engagement Pattern' WHEN anomaly_pattern <> 'Normal Behavior' THEN 'Anomaly Pattern' ELSE 'Standard Pattern' END
            AS pattern_significance FROM p""",
)
def ev_session_patterns(t: Tables) -> DataFrame:
    labelled = windows.session_patterns(_sessions(t), "views", "clicks", "buys")
    out = windows.pattern_summary(labelled, "views", "clicks", "buys")
    return rounded(
        rounded(out, 2, "total_revenue"),
        4,
        "avg_events_per_session",
        "avg_session_duration_minutes",
        "avg_purchase_amount",
        "conversion_rate_percent",
        "avg_engagement_actions",
    )


# The trigger names. The actions are examples.
TRIGGERS = [
    ("high_temperature_alert", "call the site engineer"),
    ("user_conversion_event", "enter in the bonus scheme"),
    ("system_anomaly_detection", "open an incident"),
    ("high_traffic_alert", "add two workers"),
    ("data_quality_issue", "hold the load"),
]

_TRIGGER_VALUES = ", ".join(f"('{n}', '{a}')" for n, a in TRIGGERS)


TRIGGER_SQL = f"""WITH e AS (
         SELECT 'high_temperature_alert' AS trigger_name, count(*) AS n, max(value) AS v, max(ts) AS last FROM events WHERE event_type = 'view' AND value > 50
         UNION ALL SELECT 'user_conversion_event', count(*), max({AMOUNT}), max(ts) FROM events WHERE event_type = 'purchase' AND {AMOUNT} > 90
         UNION ALL SELECT 'system_anomaly_detection', count(*), min(value), max(ts) FROM events WHERE value < 0.05
         UNION ALL SELECT 'high_traffic_alert', count(*), max(c), max(w) FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts, {EPOCH}) AS w, count(*) AS c
           FROM events GROUP BY 1 HAVING count(*) > 6)),
       p AS (SELECT e.*, action_description, CASE WHEN trigger_name LIKE '%alert%' AND n >= 5 THEN 'High Priority'
         WHEN trigger_name LIKE '%alert%' AND n >= 1 THEN 'Medium Priority' WHEN n >= 10 THEN 'High Priority' WHEN n >= 5 THEN 'Medium Priority'
         WHEN n >= 1 THEN 'Low Priority' ELSE 'No Action Required' END AS action_priority
         FROM e JOIN (VALUES {_TRIGGER_VALUES}) t(name, action_description) ON name = trigger_name)
       SELECT trigger_name, n AS triggered_count, v AS max_trigger_value, last AS last_trigger_time, action_description, action_priority,
         CASE WHEN n > 0 THEN 'Action Triggered' ELSE 'No Trigger' END AS execution_status,
         CASE WHEN n > 0 AND action_priority = 'High Priority' THEN 'Critical Response Required'
           WHEN n > 0 AND action_priority = 'Medium Priority' THEN 'Standard Response' WHEN n > 0 THEN 'Monitoring Response'
           ELSE 'No Response Needed' END AS response_category FROM p"""


@query("ev_triggers", TRIGGER_SQL)
def ev_triggers(t: Tables) -> DataFrame:
    events = t.events
    busy = windows.windowed(events, "ts", "5 minutes", [count_rows("c")])
    return windows.evaluate_triggers({**_row_rules(events), **_busy_rules(busy)}, _trigger_table(t))


def _row_rules(events: DataFrame | None) -> dict[str, windows.Rule]:
    bought, value = F.col("event_type") == "purchase", F.col("value")
    return {
        "high_temperature_alert": (events, (F.col("event_type") == "view") & (value > 50), F.max, value, "ts"),
        "user_conversion_event": (events, bought & (amount() > 90), F.max, amount(), "ts"),
        "system_anomaly_detection": (events, value < 0.05, F.min, value, "ts"),
    }


def _busy_rules(busy: DataFrame | None) -> dict[str, windows.Rule]:
    return {"high_traffic_alert": (busy, F.col("c") > 6, F.max, F.col("c"), "window_start")}


def _trigger_table(t: Tables) -> DataFrame:
    return values_df(t.spark, TRIGGERS, "trigger_name string, action_description string")


@query(
    "ev_rate_limit",
    """WITH c AS (SELECT user_id, ts, count(*) AS calls FROM events GROUP BY 1, 2),
       r AS (SELECT *, CAST(sum(calls) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT)
         AS recent_calls FROM c)
       SELECT user_id, ts, calls, recent_calls, recent_calls < 3 AS within_limit FROM r""",
)
def ev_rate_limit(t: Tables) -> DataFrame:
    return rate_exceeded(t.events, "user_id", "ts", 3600, 3)


# ---------------------------------------------------------------- streams

DELAY = "10 minutes"


def _stream(t: Tables, unique: str | None = None) -> DataFrame:
    source = feeds.read_events(t.spark, t.path("events"), t.events.schema)
    return feeds.with_late_policy(source, "ts", DELAY, unique)


SLICES = 5


def _arriving(t: Tables, start, unique: str | None = None) -> None:
    """Let the events arrive in equal stretches of event time, several files each, and run the stream after each.

    ``start`` takes the stream and runs it over what is there; each run goes on from the last one's checkpoint.
    """
    landing = scratch_path(t.spark, "landing")
    low, high = t.events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(low)) * SLICES / F.lit(high - low + 1))
    for i in range(SLICES):
        t.events.filter(F.coalesce(part, F.lit(0)) == i).repartition(4).write.mode("append").parquet(landing)
        source = feeds.read_events(t.spark, landing, t.events.schema)
        start(feeds.with_late_policy(source, "ts", DELAY, unique)).awaitTermination()


SLICE_SQL = f"(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {SLICES} // (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events)"

CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "st_tumbling",
    f"""WITH {TUMBLING} SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, event_count, purchase_events,
        round(avg_purchase_amount, 4) AS avg_purchase_amount FROM tumbling WHERE window_start + INTERVAL 5 MINUTE <= {CLOSED}""",
)
def st_tumbling(t: Tables) -> DataFrame:
    aggs = windows.event_aggs("event_type", amount())
    return rounded(feeds.drain(windows.windowed(_stream(t), "ts", "5 minutes", aggs)), 4, "avg_purchase_amount")


@query(
    "st_sliding",
    f"""WITH {SLIDING} SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, event_count, purchase_events,
        round(avg_purchase_amount, 4) AS avg_purchase_amount FROM sliding WHERE window_start + INTERVAL 10 MINUTE <= {CLOSED}""",
)
def st_sliding(t: Tables) -> DataFrame:
    aggs = windows.event_aggs("event_type", amount())
    out = feeds.drain(windows.windowed(_stream(t), "ts", "10 minutes", aggs, slide="5 minutes"))
    return rounded(out, 4, "avg_purchase_amount")


@query(
    "st_sessions",
    f"""WITH f AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS o
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM f)
       SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid
       HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""",
)
def st_sessions(t: Tables) -> DataFrame:
    return feeds.drain(windows.session_windows(_stream(t), "user_id", "ts", [count_rows("n")]))


@query(
    "st_uniques",
    f"""SELECT time_bucket(INTERVAL 10 MINUTE, ts, {EPOCH}) AS window_start, time_bucket(INTERVAL 10 MINUTE, ts, {EPOCH}) + INTERVAL 10 MINUTE AS window_end,
          count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1, 2
        HAVING time_bucket(INTERVAL 10 MINUTE, ts, {EPOCH}) + INTERVAL 10 MINUTE <= {CLOSED}""",
)
def st_uniques(t: Tables) -> DataFrame:
    return feeds.drain(windows.stream_uniques(_stream(t), "ts", "10 minutes", "user_id"))


@query("st_dedup", "SELECT event_id, user_id, event_type, value FROM events")
def st_dedup(t: Tables) -> DataFrame:
    return feeds.drain(_stream(t, "event_id").select("event_id", "user_id", "event_type", "value"))


@query(
    "st_chained_windows",
    f"""WITH {TUMBLING}, closed AS (SELECT * FROM tumbling WHERE window_start + INTERVAL 5 MINUTE <= {CLOSED})
        SELECT time_bucket(INTERVAL 1 HOUR, window_start, {EPOCH}) AS window_start, CAST(sum(event_count) AS BIGINT) AS event_count,
          max(event_count) AS busiest FROM closed GROUP BY 1
        HAVING time_bucket(INTERVAL 1 HOUR, window_start, {EPOCH}) + INTERVAL 1 HOUR <= {CLOSED}""",
)
def st_chained_windows(t: Tables) -> DataFrame:
    five = _stream(t).groupBy(F.window("ts", "5 minutes").alias("_w")).agg(count_rows("n"))
    timed = five.select(F.window_time("_w").alias("_t"), "n")
    hour = timed.groupBy(F.window("_t", "1 hour").alias("_h")).agg(F.sum("n").alias("event_count"), F.max("n").alias("busiest"))
    return feeds.drain(hour.select(F.col("_h.start").cast("timestamp_ntz").alias("window_start"), "event_count", "busiest"))


@query(
    "st_window_trend",
    f"""WITH {TUMBLING}, c AS (SELECT * FROM tumbling WHERE window_start + INTERVAL 5 MINUTE <= {CLOSED})
        SELECT window_start, event_count, lag(event_count) OVER w AS prev_value, event_count - lag(event_count) OVER w AS value_change,
          CASE WHEN lag(event_count) OVER w IS NULL THEN 'Initial Window' WHEN event_count > lag(event_count) OVER w THEN 'Increasing Trend'
            WHEN event_count < lag(event_count) OVER w THEN 'Decreasing Trend' ELSE 'Stable Trend' END AS trend_direction
        FROM c WINDOW w AS (ORDER BY window_start)""",
)
def st_window_trend(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "trend")
    handle = tables.carried(path, [], "window_start", lambda rows: windows.window_trend(rows, []))

    def start(events: DataFrame):
        closed = windows.windowed(events, "ts", "5 minutes", [count_rows("event_count")]).select("window_start", "event_count")
        return feeds.feed_batches(closed, handle, f"{path}/state")

    _arriving(t, start)
    return t.spark.read.parquet(f"{path}/out").select("window_start", "event_count", "prev_value", "value_change", "trend_direction")


@query(
    "st_window_alerts",
    f"""WITH m AS (SELECT event_type AS category, time_bucket(INTERVAL 10 MINUTE, ts, {EPOCH}) AS window_start, count(*) AS n FROM events GROUP BY 1, 2
          HAVING time_bucket(INTERVAL 10 MINUTE, ts, {EPOCH}) + INTERVAL 10 MINUTE <= {CLOSED}),
        c AS (SELECT *, lag(n) OVER w AS prev_value, n - lag(n) OVER w AS value_change,
          (n - lag(n) OVER w) * 100.0::DOUBLE / lag(n) OVER w AS p FROM m WINDOW w AS (PARTITION BY category ORDER BY window_start))
        SELECT category, window_start, n, prev_value, value_change, round(p, 1) AS change_percentage,
          CASE WHEN abs(p) >= 50 THEN 'Critical Alert' WHEN abs(p) >= 25 THEN 'Warning Alert' WHEN abs(p) >= 10 THEN 'Information Alert'
            ELSE 'Normal' END AS alert_level,
          CASE WHEN n >= 20 THEN 'High Activity' WHEN n >= 10 THEN 'Medium Activity' WHEN n >= 5 THEN 'Low Activity'
            ELSE 'Very Low Activity' END AS activity_level FROM c WHERE prev_value IS NOT NULL""",
)
def st_window_alerts(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "alerts")
    handle = tables.carried(path, ["category"], "window_start", lambda rows: windows.window_alerts(rows, ["category"], ["window_start"], "n"))

    def start(events: DataFrame):
        closed = windows.windowed(events.withColumnRenamed("event_type", "category"), "ts", "10 minutes", [count_rows("n")], ["category"])
        return feeds.feed_batches(closed.drop("window_end"), handle, f"{path}/state")

    _arriving(t, start)
    columns = ["category", "window_start", "n", "prev_value", "value_change", "change_percentage", "alert_level", "activity_level"]
    return rounded(t.spark.read.parquet(f"{path}/out").select(*columns), 1, "change_percentage")


@query("st_triggers", TRIGGER_SQL)
def st_triggers(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "triggers")
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    handle, current = windows.trigger_feed(f"{path}/table", _row_rules(None), {"busy": ("ts", "5 minutes", _busy_rules(None))}, compact_every=4)
    _arriving(t, lambda stream: feeds.feed_batches(stream, handle, f"{path}/state"))
    out = current(t.spark, events.limit(0), _trigger_table(t))
    return out.withColumn("last_trigger_time", F.col("last_trigger_time").cast("timestamp_ntz"))


@query(
    "st_sensor_stats",
    f"""WITH e AS (SELECT event_type, value, 1 - event_id % 40 / 100.0::DOUBLE AS quality, {SLICE_SQL} AS i FROM events),
       b AS (SELECT a.event_type, s.i, avg(a.value) AS m, stddev_samp(a.value) AS d FROM e a JOIN (SELECT DISTINCT i FROM e) s ON a.i <= s.i GROUP BY 1, 2),
       o AS (SELECT e.event_type, count(CASE WHEN value > m + 2 * d OR value < m - 2 * d THEN 1 END) AS n FROM e JOIN b ON e.event_type = b.event_type AND e.i = b.i GROUP BY 1),
       s AS (SELECT event_type, count(*) AS c, avg(value) AS a, stddev_samp(value) AS d, min(value) AS lo, max(value) AS hi, avg(quality) AS q FROM e GROUP BY 1)
       SELECT event_type, c AS measurement_count, round(a, 4) AS avg_value, round(d, 4) AS std_deviation, lo AS min_value, hi AS max_value,
         round(q, 4) AS avg_quality_score, n AS anomaly_count, round(n * 100.0::DOUBLE / c, 4) AS anomaly_percentage,
         CASE WHEN q >= 0.95 THEN 'Excellent' WHEN q >= 0.9 THEN 'Good' WHEN q >= 0.8 THEN 'Fair' ELSE 'Poor' END AS data_quality_rating,
         CASE WHEN round(n * 100.0::DOUBLE / c, 1) <= 2 THEN 'Normal Operation' WHEN round(n * 100.0::DOUBLE / c, 1) <= 5 THEN 'Minor Issues'
           WHEN round(n * 100.0::DOUBLE / c, 1) <= 10 THEN 'Significant Issues' ELSE 'Critical Issues' END AS anomaly_status
       FROM s JOIN o USING (event_type)""",
)
def st_sensor_stats(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "sensors")
    handle, current = windows.sensor_feed(f"{path}/table", ["event_type"], "value", "quality", compact_every=4)
    quality = 1 - F.col("event_id") % 40 / 100.0
    read = lambda df: df.select("event_type", "value", quality.alias("quality"))
    _arriving(t, lambda stream: feeds.feed_batches(read(stream), handle, f"{path}/state"))
    return rounded(current(t.spark, read(t.events.limit(0))), 4, "avg_value", "std_deviation", "avg_quality_score", "anomaly_percentage")


@query("st_feed", "SELECT event_id, event_type, strftime(ts, '%Y%m%d') AS dt, value FROM events")
def st_feed(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "feed")
    rows = _stream(t).select("event_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("dt"), "value")
    feeds.feed(rows, f"{path}/out", f"{path}/state", partition_by=["dt"]).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{path}/out")


@query(
    "st_fan_out",
    "SELECT 'a' AS sink, event_id, value FROM events UNION ALL SELECT 'b', event_id, value FROM events",
)
def st_fan_out(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "fan")
    rows = _stream(t).select("event_id", "value")
    feeds.feed_batches(rows, feeds.fan_out([f"{path}/a", f"{path}/b"]), f"{path}/state").awaitTermination()
    both = [t.spark.read.schema(rows.schema).parquet(f"{path}/{s}").select(F.lit(s).alias("sink"), "event_id", "value") for s in "ab"]
    return both[0].unionAll(both[1])


@query(
    "st_append_new",
    "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y%m%d') AS day FROM events",
)
def st_append_new(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "append")
    layout = t.events.select("user_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day"))

    def start(events: DataFrame):
        rows = events.select("user_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day"))
        return feeds.feed(feeds.new_keys(rows, rows.columns), f"{path}/out", f"{path}/state")

    _arriving(t, start)
    return t.spark.read.schema(layout.schema).parquet(f"{path}/out").select(*layout.columns)


@query(
    "st_upsert",
    """SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""",
)
def st_upsert(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "upsert")
    totals = _stream(t).groupBy("user_id", "event_type").agg(count_rows("n"), F.round(F.sum("value"), 2).alias("total"))
    feeds.feed_batches(totals, feeds.upsert_batches(f"{path}/table", ["user_id", "event_type"]), f"{path}/state", mode="update").awaitTermination()
    return feeds.current_rows(t.spark, f"{path}/table", totals.schema, ["user_id", "event_type"])
