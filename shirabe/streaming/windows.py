"""Event analytics over time windows; the same functions serve batch and streams
unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.dates import boundary_diff
from shirabe.operators.aggregate import count_rows, pct
from shirabe.operators.join import outlier_count
from shirabe.operators.project import bucket, label_when
from shirabe.operators.window import sessionize, trend, with_change
from shirabe.streaming import tables


def throughput(events: DataFrame, kind: str, ts: str, user: str, payload: str) -> DataFrame:
    """Per event type: counts, time span, payload size, events and KB per second, class."""
    base = events.groupBy(kind).agg(
        count_rows("event_count"),
        F.countDistinct(user).alias("unique_users"),
        F.min(ts).alias("first_event"),
        F.max(ts).alias("last_event"),
        F.avg(F.length(payload)).alias("avg_event_size_bytes"),
    )
    span = boundary_diff("second", F.col("first_event"), F.col("last_event"))
    per = F.when(span > 0, span).otherwise(F.lit(1))
    rates = base.withColumns(
        {
            "time_span_seconds": span,
            "events_per_second": F.col("event_count") / per,
            "kb_per_second": F.col("event_count") * F.col("avg_event_size_bytes") / per / 1024,
        }
    )
    steps = [(10, "High Throughput"), (5, "Medium Throughput"), (1, "Low Throughput")]
    return rates.withColumn("throughput_category", bucket(F.col("events_per_second"), steps, "Very Low Throughput"))


def sensor_stats(df: DataFrame, keys: list[str], value: str, quality: str, k: float = 2) -> DataFrame:
    """Per sensor group: value statistics, share of rows outside mean ± k deviations, ratings. Batch; see ``sensor_feed``."""
    extra = df.groupBy(*keys).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(quality).alias("avg_quality_score")
    )
    return sensor_ratings(outlier_count(df, keys, value, k).join(extra, keys))


def sensor_ratings(stats: DataFrame) -> DataFrame:
    """Anomaly share, quality rating and status of sensor statistics."""
    stats = stats.withColumn("anomaly_percentage", pct(F.col("anomaly_count"), F.col("measurement_count")))
    rating = [(0.95, "Excellent"), (0.90, "Good"), (0.80, "Fair")]
    share = F.round("anomaly_percentage", 1)
    status = [
        (share <= 2, "Normal Operation"),
        (share <= 5, "Minor Issues"),
        (share <= 10, "Significant Issues"),
    ]
    return stats.withColumns(
        {
            "data_quality_rating": bucket(F.col("avg_quality_score"), rating, "Poor"),
            "anomaly_status": label_when(status, "Critical Issues"),
        }
    )


def sensor_feed(folder: str, keys: list[str], value: str, quality: str, k: float = 2, compact_every: int = 20):
    """Sensor statistics of a stream: the handler of its batches and a reader of the statistics so far.

    Moments are kept in a side table, so bounds move with the stream: a reading counts as an anomaly by what was known when it came.
    """
    extra = {
        "measurement_count": (F.count(F.lit(1)), F.sum("measurement_count")),
        "min_value": (F.min(value), F.min("min_value")),
        "max_value": (F.max(value), F.max("max_value")),
        "_quality": (F.sum(F.col(quality).cast("double")), F.sum("_quality")),
        "_rated": (F.count(quality), F.sum("_rated")),
    }
    handle, merged = tables.with_moving_bounds(folder, keys, value, extra, k, compact_every)

    def current(spark: SparkSession, layout: DataFrame) -> DataFrame:
        m = F.col("moments")
        named = {
            "avg_value": F.when(m["n"] > 0, m["mean"]),
            "std_deviation": F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1))),
            "avg_quality_score": F.try_divide("_quality", "_rated"),
        }
        return sensor_ratings(merged(spark, layout).withColumns(named).drop("moments", "_quality", "_rated"))

    return handle, current


def windowed(df: DataFrame, ts: str, size: str, aggs: list[Column], keys: list[str] = (), slide: str | None = None) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) window aggregates with window_start/window_end."""
    window = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    grouped = df.groupBy(window.alias("_w"), *keys).agg(*aggs)
    ends = [F.col(f"_w.{side}").cast("timestamp_ntz").alias(f"window_{side}") for side in ("start", "end")]
    return grouped.select(*ends, *[c for c in grouped.columns if c != "_w"])


def event_aggs(kind: str, amount: Column, purchase: str = "purchase") -> list[Column]:
    """Counts every window report shows; valid on streams too."""
    bought = F.col(kind) == purchase
    return [
        count_rows("event_count"),
        F.count_if(bought).alias("purchase_events"),
        F.avg(F.when(bought, amount)).alias("avg_purchase_amount"),
    ]


def uniques(user: str) -> Column:
    """Distinct users per window, in batch."""
    return F.countDistinct(user).alias("unique_users")


def stream_uniques(df: DataFrame, ts: str, size: str, user: str) -> DataFrame:
    """Distinct users per tumbling window of a stream, exact: a row per window and user, then their number per window."""
    users = df.filter(F.col(user).isNotNull()).groupBy(F.window(ts, size).alias("_w"), user).agg(count_rows("_n"))
    timed = users.select(F.window_time("_w").alias("_t"), user)
    return windowed(timed, "_t", size, [count_rows("unique_users")])


def window_metrics(windows: DataFrame, minutes: Column | int) -> DataFrame:
    """Rate per minute, conversion rate and volume class of window aggregates."""
    # Bounds and labels.
    steps = [(20, "High Volume Window"), (10, "Medium Volume Window"), (5, "Low Volume Window")]
    return windows.withColumns(
        {
            "avg_purchase_amount": F.coalesce("avg_purchase_amount", F.lit(0).cast("double")),
            "events_per_minute": F.col("event_count") / (minutes if isinstance(minutes, Column) else F.lit(minutes)),
            "purchase_conversion_rate": F.coalesce(pct(F.col("purchase_events"), F.col("event_count")), F.lit(0.0)),
            "volume_category": bucket(F.col("event_count"), steps, "Very Low Volume Window"),
        }
    )


def window_trend(windows: DataFrame, keys: list[str], value: str = "event_count") -> DataFrame:
    """Each window against the one before: change and trend label. Batch, or through ``tables.carried`` the closed windows of a stream."""
    return trend(windows, keys, ["window_start"], value)


def window_alerts(windows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Percent change against the window before, alert and activity level; first windows drop out."""
    changed = with_change(windows, keys, order, value).filter(F.col("prev_value").isNotNull())
    size = F.abs(F.col("change_percentage"))
    alerts = [(50, "Critical Alert"), (25, "Warning Alert"), (10, "Information Alert")]
    activity = [(20, "High Activity"), (10, "Medium Activity"), (5, "Low Activity")]
    return changed.withColumns(
        {
            "alert_level": bucket(size, alerts, "Normal"),
            "activity_level": bucket(F.col(value), activity, "Very Low Activity"),
        }
    )


def session_aggs(kind: str, counted: dict[str, str], amount: Column) -> list[Column]:
    """Counts per event type and the amount of a session."""
    per_type = [F.count_if(F.col(kind) == value).alias(name) for value, name in counted.items()]
    return [count_rows("total_events"), *per_type, F.coalesce(F.sum(amount), F.lit(0)).alias("total_purchase_amount")]


def sessions(
    df: DataFrame, user: str, ts: str, unique: str, aggs: list[Column], gap_minutes: int = 30
) -> DataFrame:
    """Sessions per user by minute-boundary gaps. Batch."""
    tagged = sessionize(df, [user], ts, unique, gap_minutes)
    out = tagged.groupBy(user, "session_id").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), *aggs)
    minutes = boundary_diff("minute", F.col("session_start"), F.col("session_end"))
    return out.withColumn("session_duration_minutes", minutes)


def session_windows(
    df: DataFrame, user: str, ts: str, aggs: list[Column], gap_minutes: int = 30
) -> DataFrame:
    """Sessions per user that end a pause of ``gap_minutes`` after the last event.

    Streams (append) use Spark's session window. In batch that would send a user's
    events to one task, so sessions are numbered first and then added up.
    """
    if not df.isStreaming:
        tagged = sessionize(df, [user], ts, ts, gap_minutes, exact=True)
        last = F.max(ts).cast("timestamp_ntz") + F.expr(f"INTERVAL {gap_minutes} MINUTES")
        first = F.min(ts).cast("timestamp_ntz")
        out = tagged.groupBy(user, "session_id").agg(first.alias("session_start"), last.alias("session_end"), *aggs)
        return out.drop("session_id")
    grouped = df.groupBy(F.session_window(F.col(ts), f"{gap_minutes} minutes").alias("_w"), user).agg(*aggs)
    ends = [F.col(f"_w.{side}").cast("timestamp_ntz").alias(f"session_{side}") for side in ("start", "end")]
    return grouped.select(user, *ends, *[c for c in grouped.columns if c not in ("_w", user)])


def session_patterns(found: DataFrame, views: str, clicks: str, buys: str) -> DataFrame:
    """Engagement pattern and anomaly label of each session."""
    v, c, p = F.col(views), F.col(clicks), F.col(buys)
    total, minutes = F.col("total_events"), F.col("session_duration_minutes")
    pattern = [
        ((v >= 3) & (c >= 2) & (p >= 1), "High Engagement Purchase"),
        ((v >= 5) & (c >= 3) & (p == 0), "High Engagement No Purchase"),
        ((v >= 2) & (p >= 1), "Quick Purchase"),
        ((v >= 10) & (c >= 5), "Extensive Browsing"),
        ((total == 1) & (v == 1), "Single Page View"),
    ]
    anomaly = [
        (minutes > 120, "Unusually Long Session"),
        ((minutes < 1) & (total > 5), "Rapid Fire Events"),
        (c > v * 3, "Excessive Clicking"),
        ((p > 0) & (minutes < 2), "Suspiciously Quick Purchase"),
    ]
    return found.withColumns(
        {
            "session_pattern": label_when(pattern, "Standard Session"),
            "anomaly_pattern": label_when(anomaly, "Normal Behavior"),
        }
    )


def pattern_summary(found: DataFrame, views: str, clicks: str, buys: str) -> DataFrame:
    """Sessions per pattern and anomaly with conversion, engagement and significance."""
    out = found.groupBy("session_pattern", "anomaly_pattern").agg(
        count_rows("pattern_count"),
        F.avg("total_events").alias("avg_events_per_session"),
        F.avg("session_duration_minutes").alias("avg_session_duration_minutes"),
        F.sum(buys).alias("total_purchases"),
        F.sum("total_purchase_amount").alias("total_revenue"),
        F.avg("total_purchase_amount").alias("avg_purchase_amount"),
        pct(F.count_if(F.col(buys) > 0), F.count(F.lit(1))).alias("conversion_rate_percent"),
        F.avg(F.col(views) + F.col(clicks)).alias("avg_engagement_actions"),
    )
    rules = [
        (F.col("session_pattern").contains("Purchase") & (F.col("conversion_rate_percent") >= 50), "High Value Pattern"),
        (F.col("session_pattern").contains("Engagement"), "Engagement Pattern"),
        (F.col("anomaly_pattern") != "Normal Behavior", "Anomaly Pattern"),
    ]
    return out.withColumn("pattern_significance", label_when(rules, "Standard Pattern"))


Rule = tuple[DataFrame, Column, Callable[[Column], Column], Column, str]


def rule_results(rows: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """A row per rule on ``rows``, as conditional aggregates of one pass."""
    structs = []
    for name, (_, condition, aggregate, value, ts) in rules.items():
        structs.append(
            F.struct(
                F.lit(name).alias("trigger_name"),
                F.count_if(condition).alias("triggered_count"),
                aggregate(F.when(condition, value)).cast("double").alias("max_trigger_value"),
                F.max(F.when(condition, F.col(ts))).alias("last_trigger_time"),
            )
        )
    return rows.agg(F.array(*structs).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def evaluate_triggers(rules: dict[str, Rule], triggers: DataFrame) -> DataFrame:
    """Rule results joined to the trigger table, with priority and response class.

    A rule is (rows, condition, aggregate, reported value, time column). Rules on the
    same rows share a pass.
    """
    frames: dict[int, tuple[DataFrame, dict[str, Rule]]] = {}
    for name, rule in rules.items():
        frames.setdefault(id(rule[0]), (rule[0], {}))[1][name] = rule
    return respond(reduce(DataFrame.unionByName, [rule_results(*frame) for frame in frames.values()]), triggers)


def trigger_feed(folder: str, rules: dict[str, Rule], windows: dict[str, tuple[str, str, dict[str, Rule]]] | None = None, compact_every: int = 20):
    """Triggers of a stream: the handler of its batches and a reader of their state so far.

    ``rules`` are on rows, ``windows`` names groups of rules on counts ``c`` per ``window_start`` (time column, size, rules); the rows a rule
    names are not looked at, and its aggregate is a minimum or maximum. Counts, extremes and last times add up over batches; a
    window may get rows in several, so its count is kept by itself and judged on read.
    """
    lowest = [name for name, rule in rules.items() if rule[2] is F.min]
    value = F.when(F.col("trigger_name").isin(lowest), F.min("max_trigger_value")).otherwise(F.max("max_trigger_value"))
    merge = {"triggered_count": F.sum("triggered_count"), "max_trigger_value": value, "last_trigger_time": F.max("last_trigger_time")}
    parts = [(tables.Partials(f"{folder}/rules", ["trigger_name"], lambda rows: rule_results(rows, rules), merge, compact_every), None)]
    for name, (ts, size, judged) in (windows or {}).items():

        def count(rows: DataFrame, ts: str = ts, size: str = size) -> DataFrame:
            return windowed(rows, ts, size, [count_rows("c")]).drop("window_end")

        parts.append((tables.Partials(f"{folder}/{name}", ["window_start"], count, {"c": F.sum("c")}, compact_every), judged))

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for part, _ in parts:
                part.add(kept, batch_id)
        finally:
            kept.unpersist()

    def current(spark: SparkSession, layout: DataFrame, triggers: DataFrame) -> DataFrame:
        found = []
        for part, judged in parts:
            rows = part.merged(spark, part.partial(layout).schema)
            found.append(rows if judged is None else rule_results(rows, judged))
        return respond(reduce(DataFrame.unionByName, found), triggers)

    return handle, current


def respond(out: DataFrame, triggers: DataFrame) -> DataFrame:
    """Priority and response class of rule results, for the triggers of the table."""
    joined = out.join(triggers, "trigger_name")
    n, alert = F.col("triggered_count"), F.col("trigger_name").contains("alert")
    # Bounds and labels.
    priority = [
        (alert & (n >= 5), "High Priority"),
        (alert & (n >= 1), "Medium Priority"),
        (n >= 10, "High Priority"),
        (n >= 5, "Medium Priority"),
        (n >= 1, "Low Priority"),
    ]
    joined = joined.withColumns(
        {
            "action_priority": label_when(priority, "No Action Required"),
            "execution_status": F.when(n > 0, "Action Triggered").otherwise("No Trigger"),
        }
    )
    fired = F.col("execution_status") == "Action Triggered"
    # Labels.
    response = [
        (fired & (F.col("action_priority") == "High Priority"), "Critical Response Required"),
        (fired & (F.col("action_priority") == "Medium Priority"), "Standard Response"),
        (fired, "Monitoring Response"),
    ]
    return joined.withColumn("response_category", label_when(response, "No Response Needed"))
