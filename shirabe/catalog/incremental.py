"""Incremental load queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.registry import Tables, query
from shirabe.catalog.scans import SNAPSHOTS, _snapshots
from shirabe.operators import change, join
from shirabe.sources.readers import values_df


@query(
    "inc_lookback",
    """SELECT 'later' AS run, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' UNION ALL
       SELECT 'first', event_id FROM events WHERE ts >= TIMESTAMP '2023-12-18'""",
)
def inc_lookback(t: Tables) -> DataFrame:
    first_run = datetime(2024, 1, 1)
    loaded, empty = t.events, t.events.limit(0)
    parts = []
    for run, target in (("later", loaded), ("first", empty)):
        start = change.lookback(target, roles.EVENTS_AS_OF, 14, first_run)
        bound = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
        parts.append(t.events.filter(F.col("ts") >= bound).select(F.lit(run).alias("run"), "event_id"))
    return parts[0].unionAll(parts[1])


@query(
    "inc_append_new",
    f"WITH {SNAPSHOTS} SELECT * FROM prev UNION ALL SELECT * FROM cur WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prev)",
)
def inc_append_new(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    return change.append_new(cur, prev, ["o_orderkey"])


@query(
    "inc_track_history",
    f"""WITH {SNAPSHOTS} SELECT p.o_orderkey, p.o_custkey, p.o_orderpriority, p.o_totalprice, '20010601' AS first_seen,
          CASE WHEN c.o_orderkey IS NOT NULL THEN '20010701' ELSE '20010615' END AS last_seen
        FROM prev p LEFT JOIN cur c ON p.o_orderkey = c.o_orderkey
        UNION ALL SELECT c.*, '20010701', '20010701' FROM cur c WHERE c.o_orderkey NOT IN (SELECT o_orderkey FROM prev)""",
)
def inc_track_history(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    history = prev.withColumns({"first_seen": F.lit("20010601"), "last_seen": F.lit("20010615")})
    return change.track_history(cur, history, ["o_orderkey"], "20010701")


def _marks(t: Tables) -> DataFrame:
    rows = [("click_source", 5000, "pending"), ("view_source", 100, "pending"), ("archive_source", 9, "idle")]
    return values_df(t.spark, rows, "source_name string, last_processed_id bigint, processing_status string")


MARKS = """marks AS (SELECT * FROM (VALUES ('click_source', 5000, 'pending'), ('view_source', 100, 'pending'),
  ('archive_source', 9, 'idle')) v(source_name, last_processed_id, processing_status))"""


@query(
    "inc_since_watermark",
    f"""WITH {MARKS} SELECT event_id, event_type FROM events LEFT JOIN marks ON source_name = event_type || '_source'
        WHERE event_id > coalesce(last_processed_id, -1)""",
)
def inc_since_watermark(t: Tables) -> DataFrame:
    return change.since_watermark(t.events.select("event_id", "event_type"), _marks(t), "event_type", "event_id")


@query(
    "inc_advance_watermark",
    f"""WITH {MARKS}, top AS (SELECT event_type || '_source' AS s, max(event_id) AS m FROM events LEFT JOIN marks
          ON source_name = event_type || '_source' WHERE event_id > coalesce(last_processed_id, -1) GROUP BY 1)
        SELECT source_name, coalesce(m, last_processed_id) AS last_processed_id,
          CASE WHEN m IS NOT NULL THEN 'completed' ELSE processing_status END AS processing_status
        FROM marks LEFT JOIN top ON s = source_name""",
)
def inc_advance_watermark(t: Tables) -> DataFrame:
    marks = _marks(t)
    batch = change.since_watermark(t.events.select("event_id", "event_type"), marks, "event_type", "event_id")
    return change.advance_watermark(marks, batch, "event_type", "event_id")


@query(
    "inc_freshness",
    f"""WITH {MARKS}, c AS (SELECT event_type, count(*) AS total_records,
          count(CASE WHEN ts > TIMESTAMP '2024-01-29 12:00:00' THEN 1 END) AS recent_records,
          count(CASE WHEN ts > TIMESTAMP '2024-01-30 11:00:00' THEN 1 END) AS very_recent_records,
          min(ts) AS earliest_timestamp, max(ts) AS latest_timestamp FROM events GROUP BY 1)
        SELECT c.*, coalesce(last_processed_id, 0) AS last_processed_id, coalesce(processing_status, 'unknown') AS processing_status,
          round(recent_records * 100.0::DOUBLE / total_records, 4) AS recent_data_percentage
        FROM c LEFT JOIN marks ON source_name = event_type || '_source'""",
)
def inc_freshness(t: Tables) -> DataFrame:
    out = change.freshness(t.events, _marks(t), "event_type", "ts", roles.EVENTS_AS_OF)
    return out.withColumn("recent_data_percentage", F.round("recent_data_percentage", 4))


@query(
    "inc_unless_processed",
    f"""WITH {SNAPSHOTS} SELECT c.o_orderkey, c.o_orderpriority FROM prev p JOIN cur c ON p.o_orderkey = c.o_orderkey
        WHERE p.o_orderpriority = '5-LOW' AND c.o_orderpriority <> '5-LOW'""",
)
def inc_unless_processed(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    state = values_df(t.spark, [("20010629", "20010630")], "prev_day string, cur_day string")
    changed = join.snapshot_changes(prev, cur, ["o_orderkey"], "o_orderpriority", "5-LOW").select("o_orderkey", "o_orderpriority")
    again = change.unless_processed(state, {"prev_day": "20010629", "cur_day": "20010630"}, changed)
    fresh = change.unless_processed(state, {"prev_day": "20010630", "cur_day": "20010701"}, changed)
    return again.unionAll(fresh)


@query(
    "inc_delta_upsert",
    f"""WITH {SNAPSHOTS} SELECT * FROM cur UNION ALL SELECT * FROM prev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cur)""",
)
def inc_delta_upsert(t: Tables) -> DataFrame:
    columns = ["o_custkey", "o_orderpriority", "o_totalprice"]
    prev, cur = [s.withColumn("hash", join.row_hash(columns)) for s in _snapshots(t)]
    return change.delta_upsert(cur, prev, "o_orderkey", "hash").drop("hash")


@query(
    "inc_spans",
    """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () // 7 AS size FROM orders)
       SELECT (rn - 1) // size AS span, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS row_count FROM n GROUP BY 1""",
)
def inc_spans(t: Tables) -> DataFrame:
    return change.spans(t.orders, "o_orderkey", 7)


@query(
    "inc_apply_deletes",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)",
)
def inc_apply_deletes(t: Tables) -> DataFrame:
    flag = F.when(F.col("o_totalprice") > 490000, 1).otherwise(0)
    daily = t.orders.select(F.col("o_custkey").alias("c_custkey"), flag.alias("is_deleted"))
    return change.apply_deletes(t.customer.select("c_custkey", "c_name"), daily, "c_custkey")
